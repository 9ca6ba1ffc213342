"""The pipeline's stages, one by one, on planted documents; and the entry module without the corpus operators."""

import random
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from barweave.llm import queries

ROOT = Path(__file__).resolve().parents[2]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        k = rng.randint(8, 14)
        sentence = [rng.choice(["the", "of", "and", "to", "in", f"word{rng.randrange(3000)}", f"term{rng.randrange(3000)}"]) for _ in range(k)]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return out[:n]


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND)


def test_stages_take_effect(spark, tmp_path):
    bench = prose(40, 1)
    shared = prose(60, 2)
    rows = [(i, " ".join(prose(200, 100 + i))) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " one more"), (102, " ".join(prose(50, 3) + bench + prose(50, 4))), (103, " ".join(prose(80, 5) + shared)), (104, " ".join(shared + prose(80, 6))), (105, "BUY!! NOW!! " * 60), (106, None), (107, "")]
    rows += [(200 + i, ("WIN!! BIG!! CASH!! " + f"X{i}!! ") * 40) for i in range(8)]
    make(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, " ".join(bench))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert 105 not in seen["quality"] and set(range(60)) <= set(seen["quality"])
    assert not {100, 101} & set(seen["near_duplicates"]) and {0, 1, 102, 103, 104} <= set(seen["near_duplicates"])
    assert seen["passages"][103]["text"] == dict(rows)[103] and len(seen["passages"][104]["text"].split()) <= 82 and seen["passages"][104]["n_chars"] == len(seen["passages"][104]["text"])
    assert 102 not in seen["contamination"] and set(range(60)) <= set(seen["contamination"])
    assert set(seen["tokens"]) == set(seen["contamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["tokens"])


def test_rows_of_one_doc_id(spark):
    a, b, c, d = (prose(80, k) for k in (1, 2, 3, 4))
    near = [*d[:40], "else", *d[41:]]
    rows = [(1, a), (1, a), (2, b), (3, b), (3, c), (4, d), (5, near), (5, prose(80, 5)), (6, prose(80, 6)), (6, [*prose(80, 6), "more"]), (None, a), (None, a), (7, []), (7, [])]
    left = sorted((repr(r["doc_id"]), r["text"]) for r in corpus_pipeline.near_duplicates(spark, make(spark, [(i, " ".join(t)) for i, t in rows]), "").collect() if r["doc_id"] != 6)
    want = [(1, a), (2, b), (3, c), (4, d), (5, prose(80, 5)), (None, a), (None, a), (7, []), (7, [])]
    assert left == sorted((repr(i), " ".join(t)) for i, t in want)
    six = corpus_pipeline.near_duplicates(spark, make(spark, [(i, " ".join(t)) for i, t in rows]), "").where("doc_id = 6")
    assert six.count() == 1


def test_run_equals_the_stages_on_the_test_tables(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() < queries.table(spark, sf, "documents").count()
    assert out.where(F.col("n_tokens") < 3).count() == 0


def test_the_rest_stands_alone(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules['barweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; n = set(e.queries()); assert n and not any(x.startswith('op') or x == 'pipeline' for x in n), n; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120).returncode == 0
    import ast

    for path in (ROOT / "barweave").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), path
