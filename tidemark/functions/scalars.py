"""Scalar functions with the semantics of the usage model."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNKNOWN = "unknown"


def let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Only A-Z are folded."""
    return F.translate(text, _UPPER, _LOWER)


def found_in(text: Column, needle: str) -> Column:
    """A literal search without heed to ASCII case; false for a null text."""
    return F.coalesce(F.contains(ascii_lower(text), ascii_lower(F.lit(needle))), F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole cut off (not rounded) after six decimals; null if the whole is null or zero. Exact on all 64-bit integers."""
    base = F.nullif(whole.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    scaled = part.cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return ((scaled - scaled % base) / base).cast("double") / F.lit(1_000_000.0)


def plotted(total: Column) -> Column:
    """A total in millions, cut off after three decimals, as charts show it; 0 for a null total."""
    return F.coalesce((total.cast("decimal(38,0)") - total.cast("decimal(38,0)") % 1000) / 1000, F.lit(0)).cast("double") / 1000


def label(value: Column) -> Column:
    """The last part of a path that isn't empty; the value itself if there is none; a word for an unknown value."""
    last = F.try_element_at(F.filter(F.split(value, r"[\\/]"), lambda x: x != ""), F.lit(-1))
    return F.coalesce(last, F.nullif(value, F.lit("")), F.lit(UNKNOWN))


def whole_number(text: Column) -> Column:
    """A count from its JSON lexeme: digits within 64 bits, or null."""
    return F.when(text.rlike(r"^[0-9]+$"), F.try_cast(text, "bigint")) if hasattr(F, "try_cast") else F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint"))


def instant(text: Column) -> Column:
    """UTC time in milliseconds of an ISO text with a zone (UTC if it has none), or null."""
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$")
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"[T ]\d{2}:"), text).otherwise(F.concat(F.when(F.char_length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(text), F.lit("Z")))
    seconds = F.unix_millis(zoned.try_cast("timestamp"))
    return F.when(iso, from_millis(seconds))


def from_millis(ms: Column) -> Column:
    """UTC time without a zone from milliseconds since 1970, whatever the session's zone."""
    days = F.floor(ms / F.lit(86_400_000)).cast("int")
    rest = ms - days.cast("bigint") * 86_400_000
    midnight = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (rest.cast("decimal(18,6)") / F.lit(1000)).cast("decimal(18,6)"))


def project_path(path: Column) -> Column:
    """A normal form: dots folded; Windows paths in lower case with backslashes; no separator at the end but for a root."""
    windows = path.rlike(r"(?i)^[a-z]:") | F.startswith(path, F.lit("\\\\")) | path.rlike(r"^//[^/]+/[^/]+(/|$)")
    bare = F.regexp_replace(F.regexp_replace(path, r"(?i)^\\\\\?\\UNC\\", "//"), r"^\\\\\?\\", "")
    slashed = F.when(windows, F.lower(F.translate(bare, "\\", "/"))).otherwise(path)
    root = F.when(windows, F.regexp_extract(slashed, r"^(//[^/]+/[^/]+/?|[a-z]:/?)", 1)).otherwise(F.regexp_extract(slashed, r"^(/?)", 1))

    def folded(parts):
        def step(kept, x):
            up = (x == "..") & (F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")) != "..")
            drop = (x == "") | (x == ".") | ((x == "..") & (F.size(kept) == 0) & (root != ""))
            return F.when(drop, kept).when(up, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, x))

        return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")

    body = folded(F.split(F.substr(slashed, F.char_length(root) + 1), "/"))
    base = F.when(windows & F.startswith(root, F.lit("//")), F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))).otherwise(root)
    joined = F.when((body == "") & (base == ""), F.lit(".")).otherwise(F.concat(base, body))
    return F.when(F.nullif(path, F.lit("")).isNotNull(), F.when(windows, F.translate(joined, "/", "\\")).otherwise(joined))


def money(units: Column) -> Column:
    """A text with twelve decimals from integer units of 1e-12."""
    size = F.abs(units)
    one = F.lit(10**12).cast("decimal(13,0)")
    whole = ((size - size % one) / one).cast("decimal(38,0)").cast("string")
    return F.concat(F.when(units < 0, "-").otherwise(""), whole, F.lit("."), F.lpad((size % one).cast("decimal(12,0)").cast("string"), 12, "0"))


def compact(n: Column) -> Column:
    """A count in K, M or B with two decimals, cut off."""
    out = n.cast("string")
    for size, unit in ((10**3, "K"), (10**6, "M"), (10**9, "B")):
        hundredths = F.floor(F.abs(n) / F.lit(size // 100 if size > 100 else 1).cast("decimal(20,0)"))
        short = F.regexp_replace(F.format_string("%.2f", hundredths.cast("double") / 100), r"\.?0+$", "") if size > 10**3 else F.regexp_replace(F.format_string("%.2f", F.floor(F.abs(n) / F.lit(10)).cast("double") / 100), r"\.?0+$", "")
        out = F.when(F.abs(n) >= size, F.concat(F.when(n < 0, "-").otherwise(""), short, F.lit(unit))).otherwise(out)
    return out


def title_of(title: Column, project: Column, thread: Column) -> Column:
    """The title, or the project's label with the beginning of the thread's id."""
    return F.coalesce(title, F.concat(label(project), F.lit(" · "), F.left(thread, F.lit(8))))
