"""The pipeline against a version of each stage made elsewhere: SQL, all pairs, and the tokenizers library."""

import hashlib
import random

import pytest

import corpus_pipeline
from pagequarry.llm import queries
from tests.llm.test_text_operators import brute_groups


def corpus():
    r = random.Random(12)
    sentence = lambda n: " ".join(f"w{r.randint(0, 900)}" for _ in range(n))
    base = ["\n".join(sentence(r.randint(10, 40)) for _ in range(r.randint(2, 6))) for _ in range(70)]
    shared = sentence(30)
    texts = [*base, None, "", "too short", "Is on. " * 120]
    texts += [base[3], base[3] + "\n" + shared, base[4] + "\n" + shared, base[5] + "\n" + shared]
    for t in base[10:18]:
        w = t.split(" ")
        for k in range(0, len(w), 40):
            w[k] = f"new{k}"
        texts.append(" ".join(w))
    return [(i, t, ("en", "de", "fr")[i % 3], f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]


def by_sql(sql, rows):
    duckdb = pytest.importorskip("duckdb")
    pandas = pytest.importorskip("pandas")
    c = duckdb.connect()
    c.register("documents", pandas.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    found = c.sql(sql)
    return [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]


def test_pipeline_matches_its_stages_made_elsewhere(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = {r["doc_id"] for r in by_sql(queries.OP10_SQL, rows) if r["kept"]}
    rows = [r for r in rows if r[0] in kept]
    lines = {r["doc_id"]: r for r in by_sql(queries.OP8_SQL, rows)}
    rows = [(i, lines[i]["text"], lang, source, 0) for i, _, lang, source, _ in rows if not lines[i]["emptied"]]
    groups = brute_groups([r[1] for r in rows])
    rows = [r for k, r in enumerate(rows) if groups[k][1] == k]
    taken = by_sql(queries.OP2_SQL, rows)
    library = tokenizers.Tokenizer.from_file(queries.TOKENIZER)
    library.no_truncation()
    text = {r[0]: r[1] for r in rows}
    expected = []
    for t in taken:
        ids = library.encode(text[t["doc_id"]], add_special_tokens=False).ids
        expected.append((t["doc_id"], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()))
    assert 25 < len({d for d, *_ in got}) < len(corpus()) - 8
    assert got == sorted(expected)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "mixture", "tokens"]


def test_columns_with_the_names_of_the_stages_own_pass_through(spark):
    names = ["n_words", "kept", "n_lines", "emptied", "epoch", "domain", "n_tokens", "component_id", "lo"]
    rows = [(*r, *[f"{c} of {r[0]}" for c in names]) for r in corpus()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(r[c] == f"{c} of {r.doc_id}" for r in found for c in names), name
