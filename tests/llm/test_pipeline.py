import os
import shutil
import subprocess
import sys

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from cardinia.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity  # noqa: E402
from tests.llm.common import awkward, frame  # noqa: E402
from tests.oracle import SMALL  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with near copies, labels for half of them."""
    out = tmp_path_factory.mktemp("corpus")
    near = ["the quick brown fox jumps over the lazy dog near the river bank today " * 3 + f"end{i // 9}" for i in range(12)]
    toxic = [f"plain words number {i} and one idiot among them" for i in range(60)]
    clean = [f"plain words number {i} and no such thing among those" for i in range(60, 200)]
    frame(spark, awkward([*near, *toxic, *clean])).write.parquet(str(out / "documents.parquet"))
    rows = awkward([*near, *toxic, *clean])
    labels = [(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "byte_bpe"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        before = docs.collect()
        if name == "toxicity":
            rejected = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
            assert rejected and {r.doc_id for r in before} - set(ids(out)) == rejected
            assert all("idiot" in r.text for r in before if r.doc_id in rejected)
        elif name == "exact_dedup":
            assert ids(out) == sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).where("kept").collect())
        elif name == "jaccard_join":
            assert ids(out) == sorted(r.doc_id for r in jaccard_join.near_duplicates(docs).collect() if r.doc_id == r.component_id)
            assert out.count() < len(before)
        elif name == "mixing":
            taken = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 0 for r in mixing.mix(docs).collect()}
            assert ids(out) == sorted(i for i, n in taken.items() for _ in range(n))
        else:
            assert sorted(tuple(r) for r in out.collect()) == sorted((r.doc_id, *bpe.digests(r.text)) for r in before)
            break
        assert out.schema.names == docs.schema.names
        out.write.parquet(path := f"{folder}/{name}")
        docs = spark.read.parquet(path)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, out.collect()))


def test_on_the_small_tables(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_the_rest_stands_without_this_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    script = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", script], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    found = subprocess.run(["grep", "-rln", "llm", str(copy / "cardinia"), str(copy / "tests")], capture_output=True, text=True).stdout
    assert found == ""
