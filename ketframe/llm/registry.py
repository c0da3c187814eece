"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from ketframe.llm import chat, decontaminate, hard_negatives, language_id, line_dedup, pipeline, quality_classifier, quality_rules, secrets, sentencepiece, simhash, substrings, token_alignment, warc


def queries():
    return {
        "op1_secrets": secrets.op1,
        "op2_warc": warc.op2,
        "op3_simhash": simhash.op3,
        "op4_line_dedup": line_dedup.op4,
        "op5_substrings": substrings.op5,
        "op6_chat": chat.op6,
        "op7_quality_rules": quality_rules.op7,
        "op8_decontaminate": decontaminate.op8,
        "op9_sentencepiece": sentencepiece.op9,
        "op10_quality_classifier": quality_classifier.op10,
        "op11_token_alignment": token_alignment.op11,
        "op12_language_id": language_id.op12,
        "op13_hard_negatives": hard_negatives.op13,
        "pipeline": pipeline.run,
    }


def oracle_sql():
    own = {"op5_substrings": substrings.OP5_SQL, "op6_chat": chat.OP6_SQL, "op7_quality_rules": quality_rules.OP7_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
    return own | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
