"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import bloomlm, decontam, lattice, pii, quality_model, quality_rules, simhash, tokencount, toxicity, warc

QUERIES = {
    "op1_quality_classifier": quality_model.query,
    "op2_warc": warc.query,
    "op3_toxicity": toxicity.query,
    "op4_token_counts": tokencount.query,
    "op5_simhash": simhash.query,
    "op6_pii": pii.query,
    "op7_lm_scoring": bloomlm.query,
    "op8_decontamination": decontam.query,
    "op9_sentencepiece": lattice.query,
    "op10_quality_rules": quality_rules.query,
}

#: Where SQL can say the same over whole tables.
ORACLE_SQL = {"op2_warc": warc.ORACLE_SQL, "op8_decontamination": decontam.ORACLE_SQL, "op10_quality_rules": quality_rules.ORACLE_SQL}
