"""Stages of the pipeline on documents with nulls, repeated rows, empty texts and extra columns."""

import re

import corpus_pipeline as CP
import pytest
from pyspark.sql import functions as F

SECRET = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
SF = "/root/testdata/sf0.001"
PROSE = "Of the reeation and thening was that for with on " + " ".join(f"inthe{chr(97 + i % 26)}r{chr(97 + i % 7)} ation" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    near = PROSE.replace("reeation", "reeations")
    rows = [
        (None, None, None, None, None), (900, "", "en", "s", 0), (900, "", "en", "s", 0), (901, PROSE, None, "s", len(PROSE)),
        (901, PROSE, None, "s", len(PROSE)), (902, near, "en", None, None), (None, PROSE + " more", "en", "s", 3),
        (903, f"Before it. {leak} After it.", "en", "s", 5), (904, f"The key follows here. token = {SECRET} and that is all of it.", "en", "s", 6),
    ]
    both = given.unionByName(spark.createDataFrame(rows, given.schema))
    return both.withColumn("_key", F.lit("clash")).withColumn("component_id", F.lit(1))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def everything(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("place", range(len(CP.STAGES)))
def test_stage_on_odd_rows(spark, docs, place):
    name, stage = CP.STAGES[place]
    plain = docs if place in (0, 3) else docs.drop("_key", "component_id")
    out = stage(spark, plain, SF)
    got = everything(out)
    if place < len(CP.STAGES) - 1:
        assert out.columns == plain.columns
    if name in ("quality", "decontamination"):
        rows = everything(plain)
        assert all(r in rows for r in got)
    if name == "near_duplicates":
        rows = list(set(everything(plain)))
        sets = [shingles(r[1]) for r in rows]
        group = list(range(len(rows)))
        for i, a in enumerate(sets):
            for j in range(i):
                if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                    group = [group[j] if g == group[i] else g for g in group]
        kept = [rows.index(r) for r in got]
        empty = [i for i, s in enumerate(sets) if not s]
        assert sorted(group[i] for i in kept if i not in empty) == sorted({group[i] for i in range(len(rows)) if i not in empty})
        assert set(empty) <= set(kept)
    if name == "decontamination":
        assert 903 not in {r[0] for r in got} and {900, 901, 902, 904} <= {r[0] for r in got}
    if name == "secrets":
        assert len(got) == plain.count()
        (masked,) = [r for r in got if r[0] == 904]
        assert SECRET not in masked[1] and masked[4] == len(masked[1])
    if name == "bpe":
        assert len(got) == plain.count() and out.where("NOT round_trip").isEmpty()


def test_stages_on_empty_documents(spark, docs):
    empty = docs.drop("_key", "component_id").limit(0)
    for name, stage in CP.STAGES[1:]:
        assert stage(spark, empty, SF).count() == 0, name
