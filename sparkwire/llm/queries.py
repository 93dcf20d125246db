"""The operators' queries over whole tables, and their SQL."""

from __future__ import annotations

from . import ann, bpe, decontam, divergence, langid, linededup, lm_score, packing, pii, simhash, trie, urlfilter, warc
from .common import table


def _over(name, operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict:
    return {
        "op1_lm_score": _over("documents", lm_score.score),
        "op2_language_id": _over("documents", langid.digest),
        "op3_nearest_neighbours": _over("embeddings", ann.search),
        "op4_decontamination": decontam.query,
        "op5_url_filter": urlfilter.query,
        "op6_warc": _over("pages", warc.digest),
        "op7_packing": _over("documents", packing.pack),
        "op8_simhash_dedup": _over("documents", simhash.near_duplicates),
        "op9_pii_surrogates": _over("documents", pii.digest),
        "op10_line_dedup": _over("documents", linededup.digest),
        "op11_prefix_trie": _over("conversations", trie.prefix_trie),
        "op12_byte_bpe": _over("documents", bpe.digest),
        "op13_source_divergence": _over("documents", divergence.audit),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": urlfilter.SQL, "op6_warc": warc.SQL, "op10_line_dedup": linededup.SQL, "op11_prefix_trie": trie.SQL, "op13_source_divergence": divergence.SQL}
