"""Activity logs for tests, written line by line."""

import datetime as dt
import json


class Log:
    """Each call adds a line, a minute after the one before."""

    def __init__(self, hour=9):
        self.lines, self.at = [], dt.datetime(2031, 5, 20, hour)

    def put(self, kind, payload, at="now"):
        self.at += dt.timedelta(minutes=1)
        stamp = self.at.strftime("%Y-%m-%dT%H:%M:%SZ") if at == "now" else at
        self.lines.append(json.dumps({"type": kind, "payload": payload} | ({"timestamp": stamp} if stamp else {})))
        return self

    def session(self, name, at="now", **more):
        return self.put("session_meta", {"id": name, "cwd": "/srv/site"} | more, at)

    def fork(self, name, parent):
        """A task made now from another one."""
        made = (self.at + dt.timedelta(minutes=1)).strftime("%Y-%m-%dT%H:%M:%SZ")
        return self.session(name, forked_from_id=parent, timestamp=made)

    def turn(self, name, model="big", effort="low", **more):
        return self.put("turn_context", {"turn_id": name, "model": model, "effort": effort} | more)

    def spent(self, response, tokens, at="now", **more):
        counts = tokens if isinstance(tokens, dict) else {"total_tokens": tokens, "input_tokens": tokens}
        return self.put("token_usage_record", {"response_id": response, "usage": counts} | more, at)

    def totals(self, total=None, last=None, limit=None, at="now"):
        info = {name: {"input_tokens": n, "total_tokens": n} for name, n in (("total_token_usage", total), ("last_token_usage", last)) if n is not None}
        return self.put("event_msg", {"type": "token_count", "info": info} | ({"rate_limits": {"limit_id": limit}} if limit else {}), at)

    def raw(self, text):
        self.lines.append(text)
        return self

    def text(self, tail=""):
        return "".join(x + "\n" for x in self.lines) + tail
