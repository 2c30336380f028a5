"""Every registered query of the subpackage over the smallest tables: the contract's columns and rows, and the SQL where there is one."""

import os
import zlib

import duckdb
import pytest

from corpuscle.llm import queries

CONTRACT = {
    "op1_crf_main_text": ("pages", "page_id long, url string, text string, n_chars long"),
    "op2_maxent_lm": ("documents", "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"),
    "op3_naive_bayes_language": ("documents", "doc_id long, held_out boolean, lang_pred string, score double"),
    "op4_curriculum_mix": ("documents", "doc_id long, size long, source_size long, target double, taken long"),
    "op5_bucket_pointer_repeats": ("documents", "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"),
    "op6_positional_decontamination": ("documents", "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"),
    "op7_noisy_or_toxicity": ("documents", "doc_id long, held_out boolean, score double, predicted int"),
    "op8_crf_quality": ("documents", "doc_id long, held_out boolean, score double, predicted int"),
    "op9_balanced_posting_lists": (None, "query_id long, rank int, vec_id long, score double"),
    "op10_minhash_near_dedup": ("documents", "doc_id long, n_shingles long, component_id long, kept boolean"),
}
HELD = {"op2_maxent_lm": (7, 2), "op3_naive_bayes_language": (4, 2), "op7_noisy_or_toxicity": (5, 0), "op8_crf_quality": (5, 0)}
SHORT = {"bigint": "long", "int": "int", "string": "string", "double": "double", "boolean": "boolean"}


def test_all_ten_are_registered():
    assert list(queries.QUERIES) == list(CONTRACT)


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, data, name):
    table, columns = CONTRACT[name]
    out = queries.QUERIES[name](spark, data)
    assert ", ".join(f"{f.name} {SHORT[f.dataType.simpleString()]}" for f in out.schema.fields if f.name in {c.split()[0] for c in columns.split(", ")}) == columns
    rows = out.collect()
    if table:
        key = "page_id" if table == "pages" else "doc_id"
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(key).collect())
    if name in HELD:
        mod, held = HELD[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) for r in rows)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
        names = [c.split()[0] for c in columns.split(", ")]
        want = con.execute(queries.ORACLES[name]).df()
        show = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        extra = sorted(set(want.columns) - set(names))
        assert not extra or set(extra) <= set(out.columns)
        assert sorted(map(str, (show(r[n] for n in names) for r in rows))) == sorted(map(str, (show(r) for r in want[names].itertuples(index=False))))
