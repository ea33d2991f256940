from __future__ import annotations

import hashlib
import re

import duckdb
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from fettle.llm import linededup, pieces, queries
from fettle.session import settle
from tests.llm.test_jaccard import shingles

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in P.STAGES:
        docs = settle(stage(spark, docs, SF), name.replace(" ", "-"))
        sizes.append(docs.count())
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[-1] > sizes[0] / 2
    assert sorted(map(str, docs.collect())) == sorted(map(str, P.run(spark, SF).collect()))


def test_near_copies_and_contaminated_documents_go(spark):
    base = [f"w{k}" for k in range(200)]
    near = base[:100] + ["other"] + base[101:]
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, passage), (4, " ".join(f"v{k}" for k in range(80)))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, SF).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in P.decontamination(spark, docs, SF).collect()) == [1, 2, 4]


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    for table in (odd_docs, no_docs):
        for _, stage in P.STAGES:
            assert stage(spark, table, SF).count() <= table.count()


def without_shared_lines(docs: dict[int, str]) -> dict[int, str]:
    """Texts without the shortest runs of ten words that an earlier document holds too."""
    seen, out = set(), {}
    for k in sorted(docs):
        lines = docs[k].split("\n")
        own = [(i, x.strip(linededup.BLANKS), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate(lines) if x.strip(linededup.BLANKS)]
        found = set()
        for a in range(len(own)):
            for step in (1, -1):
                n, b = own[a][2], a
                while n < linededup.MIN_WORDS and 0 <= b + step < len(own):
                    b += step
                    n += own[b][2]
                if n >= linededup.MIN_WORDS:
                    found.add((min(a, b), max(a, b) + 1))
        text = {(a, e): tuple(x for _, x, _ in own[a:e]) for a, e in found}
        gone = {i for (a, e), run in text.items() if run in seen for i, _, _ in own[a:e]}
        seen |= set(text.values())
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or left.strip(linededup.BLANKS + "\n"):
            out[k] = left
    return out


def one_of_each(docs: dict[int, str]) -> dict[int, str]:
    """The texts with the smallest id of their component, by comparing all pairs."""
    sets, least = {k: shingles(t, 5) for k, t in docs.items()}, {k: k for k in docs}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for a in sorted(docs):
        for b in sorted(docs):
            if b < a and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {k: t for k, t in docs.items() if root(k) == k}


def test_the_whole_pipeline_equals_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    con.execute(f"CREATE TABLE documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.oracle_sql()['op10_quality_rules']}) WHERE kept").fetchall()}
    docs = {k: t for k, t in con.execute("SELECT doc_id, text FROM documents").fetchall() if k in kept}
    docs = one_of_each(without_shared_lines(docs))
    con.execute("DELETE FROM documents")
    con.executemany("INSERT INTO documents (doc_id, text) VALUES (?, ?)", list(docs.items()))
    hit = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.oracle_sql()['op2_benchmark_decontamination']}) WHERE contaminated").fetchall()}
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {k: (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))) for k, t in docs.items() if k not in hit for ids in [model.encode(t)]}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in P.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < 200


def test_odd_rows_and_clashing_names(spark, odd_docs, no_docs):
    extra = odd_docs.withColumns({n: F.lit(1) for n in ("row", "run", "lines", "c", "star", "ids_", "kept", "n_words", "component_id", "n_shingles", "items")})
    texts = lambda df: sorted(str(r.text) for r in df.collect())
    assert P.quality_rules(spark, extra, SF).columns == extra.columns
    assert all(r.text and len(r.text.split()) >= 50 for r in P.quality_rules(spark, extra, SF).collect())
    assert texts(P.line_dedup(spark, extra, SF)) == texts(extra)
    clean = P.decontamination(spark, extra, SF)
    assert texts(clean) == texts(extra) and clean.columns == extra.columns
    left = P.near_duplicates(spark, extra, SF)
    assert left.columns == extra.columns and left.where("text IS NULL").count() == extra.where("text IS NULL").count()
    told = {r.doc_id: r.n_tokens for r in P.tokenize(spark, extra.where("doc_id IS NOT NULL"), SF).collect()}
    assert told[0] == 0 and told[1] == 0 and told[10] >= 40_000
