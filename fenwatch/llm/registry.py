"""The queries of this package, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from fenwatch.llm import chat_format, decontaminate, embeddings, licenses, mixing, neighbours, phrases, quality, simhash, token_files, url_filter, warc, whitening


def queries():
    return {
        "op1_warc": warc.op1_warc,
        "op2_token_files": token_files.op2_token_files,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_simhash": simhash.op5_simhash,
        "op6_embeddings": embeddings.op6_embeddings,
        "op7_quality": quality.op7_quality,
        "op8_mixing": mixing.op8_mixing,
        "op9_licenses": licenses.op9_licenses,
        "op10_chat_format": chat_format.op10_chat_format,
        "op11_neighbours": neighbours.op11_neighbours,
        "op12_whitening": whitening.op12_whitening,
        "op13_phrases": phrases.op13_phrases,
    }


def oracle_sql():
    return {"op1_warc": warc.ORACLE, "op3_url_filter": url_filter.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op6_embeddings": embeddings.ORACLE, "op9_licenses": licenses.ORACLE, "op10_chat_format": chat_format.ORACLE, "op13_phrases": phrases.ORACLE}
