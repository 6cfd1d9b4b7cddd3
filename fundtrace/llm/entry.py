"""Queries of this subpackage, by number."""

from fundtrace.llm import collocations, decontaminate, html_text, jaccard, language, licences, odd_sketches, packing, quality_model, quality_rules, spelling, substring, toxicity


def queries() -> dict:
    return {
        "op1_html_text": html_text.query,
        "op2_toxicity": toxicity.query,
        "op3_decontamination": decontaminate.query,
        "op4_quality_model": quality_model.query,
        "op5_quality_rules": quality_rules.query,
        "op6_jaccard_join": jaccard.query,
        "op7_language": language.query,
        "op8_licence_scan": licences.query,
        "op9_packing": packing.query,
        "op10_substring_dedup": substring.query,
        "op11_spelling": spelling.query,
        "op12_collocations": collocations.query,
        "op13_odd_sketches": odd_sketches.query,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the result; the fitted operators, page texts and tokens have tests instead."""
    return {
        "op3_decontamination": decontaminate.SQL,
        "op5_quality_rules": quality_rules.SQL,
        "op6_jaccard_join": jaccard.SQL,
        "op8_licence_scan": licences.SQL,
        "op10_substring_dedup": substring.SQL,
        "op11_spelling": spelling.SQL,
        "op12_collocations": collocations.SQL,
        "op13_odd_sketches": odd_sketches.SQL,
    }
