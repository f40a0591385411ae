"""The stages one after another on a fixture, and the registration of the queries."""

from __future__ import annotations

import random
import re
from itertools import combinations
from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
TOKEN = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"


def words(rng: random.Random, n: int) -> str:
    w = ["".join(rng.choice("bcdlmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return " ".join(w).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> tuple[str, dict]:
    rng = random.Random(12)
    d = str(tmp_path_factory.mktemp("sf"))
    bench = [(i, words(rng, 30)) for i in range(5)]
    texts: dict[int, str] = {i: words(rng, rng.randrange(40, 120)) for i in range(120)}
    truth = {"bad": set(range(0, 120, 10)), "copies": {}, "leaks": {25, 55}, "secrets": {31, 33}}
    for i in truth["bad"]:
        texts[i] = " ".join(rng.choice(["BUY!!", "$$$", "###NOW", "%%%x"]) for _ in range(50))
    for i in truth["leaks"]:
        texts[i] += " " + bench[i % 5][1]
    for i in truth["secrets"]:
        texts[i] += f' token = "{TOKEN}"'
    for i, j in ((1, 201), (2, 202), (2, 203)):
        w = texts[i].split(" ")
        w[len(w) // 2] = "other"
        texts[j] = " ".join(w) if j != 203 else texts[i]
        truth["copies"][j] = i
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()] + [(300, None, None, None, None), (301, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i not in truth["bad"]), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, truth | {"texts": texts, "bench": bench}


def test_each_stage_decides_what_brute_force_does(spark, folder):
    d, t = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts: dict[int, str] = t["texts"]
    wanted = set(texts) - t["bad"]
    grams = lambda x: {tuple(x[i : i + 3]) for i in range(len(x) - 2)}
    sets = {i: grams(re.findall(r"[a-z0-9]+", texts[i].lower())) for i in wanted}
    near = {(a, b) for a, b in combinations(sorted(wanted), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    after = {"quality": wanted, "near_duplicates": wanted - {b for _, b in near}}
    held = {i for i in wanted for _, x in t["bench"] if x.lower().strip(".") in texts[i].lower()}
    after["decontamination"] = after["near_duplicates"] - held
    after["secrets"] = after["decontamination"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        path = f"{d}/after_{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert {r.doc_id for r in docs.collect()} == after[name], name
    assert docs.where(f"text LIKE '%{TOKEN}%'").count() == 0 and docs.where("text LIKE '%[SECRET]%'").count() == 2
    assert docs.where("n_chars != length(text)").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {x for r in mixed for x in r.doc_ids if x is not None} <= after["secrets"]
    assert len(corpus_pipeline.run(spark, d).collect()) == len(mixed)


def test_empty_tables(spark, tmp_path):
    for n, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n for n in range(1, 11) if any(x.startswith(f"op{n}_") for x in names)} == set(range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "lexiloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p
