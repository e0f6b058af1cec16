"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import chat, decontaminate, lm, minhash, packing, periodic, pii, quality, substrings, templates, toxicity, variants, warc


def queries() -> dict:
    return {
        "op1_pii_skip_chain": pii.op1,
        "op2_warc_derivatives": warc.op2,
        "op3_packing": packing.op3,
        "op4_chat_format": chat.op4,
        "op5_quality_rules": quality.op5,
        "op6_minhash": minhash.op6,
        "op7_decontaminate": decontaminate.op7,
        "op8_toxicity_pu": toxicity.op8,
        "op9_ppm_score": lm.op9,
        "op10_substring_dedup": substrings.op10,
        "op11_main_text": templates.op11,
        "op12_spelling_variants": variants.op12,
        "op13_periodic_runs": periodic.op13,
    }


def oracle_sql() -> dict:
    return {"op4_chat_format": chat.ORACLE, "op5_quality_rules": quality.ORACLE, "op6_minhash": minhash.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op10_substring_dedup": substrings.ORACLE, "op12_spelling_variants": variants.ORACLE}
