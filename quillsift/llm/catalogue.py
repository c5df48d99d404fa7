"""The registered queries of this subpackage and their SQL equivalents, where SQL can express them."""

from __future__ import annotations

from . import decontam, html, license, packing, pii, quality, simhash, sstable, tokencount, urlfilter


def queries() -> dict:
    return {
        "op1_packing": packing.op1,
        "op2_quality_rules": quality.op2,
        "op3_url_filters": urlfilter.op3,
        "op4_decontamination": decontam.op4,
        "op5_token_counts": tokencount.op5,
        "op6_license_scans": license.op6,
        "op7_simhash": simhash.op7,
        "op8_pii": pii.op8,
        "op9_sstable": sstable.op9,
        "op10_html_extraction": html.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.OP2_SQL, "op4_decontamination": decontam.OP4_SQL, "op6_license_scans": license.OP6_SQL}
