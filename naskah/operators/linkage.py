"""Citation to reference linkage and file to reference pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from naskah.constants import TITLE_ACCEPT
from naskah.functions import passages as P
from naskah.functions import similarity as S
from naskah.functions import text as T
from naskah.session import materialize

YEAR_WINDOW = 2
YEAR_COST = DISTANCE_COST = 0.15
ET_AL_BONUS, ET_AL_PENALTY = 0.05, 0.2


def cite_surname(key: Column) -> Column:
    authors = T.strip(F.regexp_replace(key, T.js(r",\s*\d{4}.*$"), ""))
    first = F.get(F.split(authors, T.js(r"\s*(?:&|et\s+al\.?|,)\s*")), F.lit(0))
    return T.fold_name(first)


def cite_year(key: Column) -> Column:
    return F.regexp_extract(key, r"([0-9]{4})", 1).try_cast("int")


def ref_surnames(author: Column) -> Column:
    """Folded surnames of an author list, one-letter names dropped."""
    parts = F.split(author, T.js(r"\s*(?:,\s*&|&|\band\b|\bdan\b)\s*"))
    names = F.transform(parts, lambda p: T.fold_name(T.strip(F.substring_index(p, ",", 1))))
    return F.filter(names, lambda n: F.length(n) > 1)


def _words(name: Column) -> Column:
    return F.when(name.rlike(T.WS), F.split(name, T.WS + "+")).otherwise(
        F.array().cast("array<string>")
    )


def all_names(surnames: Column) -> Column:
    """Surnames and the words of those with several words."""
    return F.array_distinct(F.concat(surnames, F.flatten(F.transform(surnames, _words))))


def max_distance(length: Column) -> Column:
    """Edits allowed for a cited surname of this length."""
    return F.greatest(F.lit(1), F.floor(length * 0.3).cast("int"))


def _reach(length: Column) -> Column:
    # |L - n| <= 0.3 L  implies  L <= n / 0.7
    return F.greatest(F.lit(1), F.ceil(length * 0.43).cast("int"))


def _prefixes(name: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.left(name, i))


def _tagged(tag: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(tag), n))


def close_names(cited: DataFrame, names: DataFrame) -> DataFrame:
    """``surname, name, is_surname, distance`` of names within reach of a cited surname.

    ``cited`` has distinct surnames, ``names`` distinct ``name, is_surname``. A surname is at
    distance 0 when either is a prefix of the other, any name when equal; else the edit distance
    counts. Both sides emit exact keys: the whole of one and every prefix of the other, and pieces
    for edits. A pair that meets several times is compared once.
    """
    s, n = F.col("surname"), F.col("name")
    left = cited.filter(F.length(s) > 0).select(
        s,
        F.explode(
            F.array_distinct(
                F.concat(
                    _tagged("p:", F.array(s)), _tagged("q:", _prefixes(s)), _tagged("w:", F.array(s)),
                    S.piece_keys(s, max_distance),
                )
            )
        ).alias("name_key"),
    )
    prefix = F.when(F.col("is_surname"), F.concat(_tagged("p:", _prefixes(n)), _tagged("q:", F.array(n))))
    right = names.filter(F.length(n) > 0).select(
        n, "is_surname",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.coalesce(prefix, F.array().cast("array<string>")), _tagged("w:", F.array(n)),
                    S.probe_keys(n, max_distance, _reach),
                )
            )
        ).alias("name_key"),
    )
    pairs = left.join(right, "name_key").select("surname", "name", "is_surname").distinct()
    near = F.col("is_surname") & (F.startswith(n, s) | F.startswith(s, n))
    return pairs.withColumn("distance", F.when(near, 0).otherwise(F.levenshtein(s, n))).filter(
        F.col("distance") <= max_distance(F.length(s))
    )


def match_candidates(keys: DataFrame, refs: DataFrame) -> DataFrame:
    """Every (citation key, author, year) that passes the gates, with its confidence.

    References that share author and year score alike and the lowest id wins, so they
    are folded first. Names are compared once per distinct pair of the corpus; jobs meet
    them by equi-joins. A key or reference without a year counts as year 0, one with a year
    that is no number passes the year gate.
    """
    key = F.col("citation_key")
    cites = keys.select("job_id", "citation_key").distinct().select(
        "job_id", "citation_key",
        cite_surname(key).alias("surname"),
        F.coalesce(cite_year(key), F.lit(0)).alias("cite_year"),
        key.rlike(T.js(r"et\s+al\.", True)).alias("et_al"),
    )
    authors_of = refs.select("author").distinct().select("author", ref_surnames(F.col("author")).alias("surnames"))
    words = F.flatten(F.transform("surnames", _words))
    named = authors_of.select(
        "author",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.transform("surnames", lambda n: F.struct(n.alias("name"), F.lit(True).alias("is_surname"))),
                    F.transform(words, lambda n: F.struct(n.alias("name"), F.lit(False).alias("is_surname"))),
                )
            )
        ).alias("n"),
    ).select("author", "n.*")
    close = (
        close_names(cites.select("surname").distinct(), named.select("name", "is_surname").distinct())
        .join(named, ["name", "is_surname"])
        .groupBy("surname", "author").agg(F.min("distance").alias("distance"))
    )
    year = F.col("year").cast("string")
    entries = (
        refs.groupBy("job_id", "author", "year")
        .agg(F.min(F.struct("reference_id", "title")).alias("ref"))
        .select(
            "job_id", "author", "ref",
            F.when(F.coalesce(F.trim(year), F.lit("")) == "", 0).otherwise(year.try_cast("int")).alias("ref_year"),
        )
        .join(authors_of.select("author", F.size("surnames").alias("authors")), "author")
        .join(close, "author")
    )
    gap = F.abs(F.col("ref_year") - F.col("cite_year"))
    pairs = cites.join(entries, ["job_id", "surname"]).filter(F.col("ref_year").isNull() | (gap <= YEAR_WINDOW))
    # A year that is no number costs nothing and is never exact.
    authors = F.col("authors")
    raw = (
        F.lit(1.0)
        - F.coalesce(gap, F.lit(0)) * YEAR_COST
        - F.col("distance") * DISTANCE_COST
    )
    scored = (
        F.when(F.col("et_al") & (authors >= 3), F.least(F.lit(1.0), raw + ET_AL_BONUS))
        .when(F.col("et_al") & (authors == 1), raw - ET_AL_PENALTY)
        .otherwise(raw)
    )
    return pairs.select(
        "job_id",
        "citation_key",
        F.col("ref.reference_id").alias("reference_id"),
        F.col("ref.title").alias("reference_title"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), scored)).alias("raw_confidence"),
        F.when((F.col("distance") == 0) & (gap == 0), "exact").otherwise("fuzzy").alias("match_type"),
    )


def match_citations(keys: DataFrame, refs: DataFrame) -> DataFrame:
    """Best reference per citation key; keys without one stay as ``unmatched``.

    The distinct keys feed three branches; they are written once, as finding them reads every page.
    """
    keys = materialize(keys.select("job_id", "citation_key").distinct(), "citation-keys")
    best = (
        match_candidates(keys, refs)
        .groupBy("job_id", "citation_key")
        .agg(
            F.max_by(
                F.struct("reference_id", "reference_title", "raw_confidence", "match_type"),
                F.struct("raw_confidence", (-F.col("reference_id")).alias("o")),
            ).alias("b")
        )
    )
    return (
        keys.join(best, ["job_id", "citation_key"], "left")
        .select(
            "job_id",
            "citation_key",
            "b.reference_id",
            "b.reference_title",
            F.coalesce(T.round2(F.col("b.raw_confidence")), F.lit(0.0)).alias("confidence"),
            F.coalesce("b.match_type", F.lit("unmatched")).alias("match_type"),
        )
    )


def orphan_citations(matches: DataFrame) -> DataFrame:
    """Citation keys without a reference."""
    return matches.filter(F.col("match_type") == "unmatched").select("job_id", "citation_key")


def unused_references(refs: DataFrame, matches: DataFrame) -> DataFrame:
    """References that no citation points to."""
    used = matches.filter(F.col("reference_id").isNotNull()).select("reference_id").distinct()
    return refs.join(used, "reference_id", "left_anti")


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose keys are not in ``right``."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


_GRAM = 4


def _title_tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda t: F.length(t) >= 3)


def pair_files(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Best reference of the same job for each file (``job_id, file_id, title, first_page``).

    A score above 0 needs a shared token or the reference title inside the file text, so
    candidates share a token or the first characters of the title. A file emits only those first
    characters that a title of its job has; each is at most ``_GRAM`` letters, so a job has few of them.
    """
    query = T.strip(
        F.concat_ws(
            " ",
            F.nullif(F.col("title"), F.lit("")),
            F.nullif(F.left("first_page", F.lit(500)), F.lit("")),
        )
    )
    norm = F.col("norm")
    q = (
        files.select("job_id", "file_id", T.fold_title(query).alias("norm"))
        .withColumn("tokens", _title_tokens(norm))
    )
    c = (
        refs.groupBy("job_id", "author", "year", F.col("title").alias("ref_title"))
        .agg(F.min("reference_id").alias("reference_id"))
        .withColumn("title_norm", T.fold_title(F.col("ref_title")))
        .withColumn(
            "c_tokens",
            _title_tokens(T.fold_title(F.concat_ws(" ", "author", "year", "ref_title"))),
        )
        .withColumn("last_name", F.element_at(F.split(T.fold_title(F.col("author")), " "), -1))
    )
    heads = c.filter("title_norm <> ''").groupBy("job_id").agg(F.collect_set(F.left("title_norm", F.lit(_GRAM))).alias("heads"))
    met = F.filter(F.coalesce("heads", F.array().cast("array<string>")), lambda h: F.contains(norm, h))
    q_keys = q.filter(F.size("tokens") > 0).join(heads, "job_id", "left").select(
        "job_id", "file_id",
        F.explode(F.array_distinct(F.concat(_tagged("t:", F.col("tokens")), _tagged("g:", met)))).alias("pair_key"),
    )
    c_keys = c.select(
        "job_id", "reference_id",
        F.explode(
            F.concat(
                F.transform(F.array_distinct("c_tokens"), lambda t: F.concat(F.lit("t:"), t)),
                F.when(
                    F.col("title_norm") != "",
                    F.array(F.concat(F.lit("g:"), F.left("title_norm", F.lit(_GRAM)))),
                ).otherwise(F.array().cast("array<string>")),
            )
        ).alias("pair_key"),
    )
    pairs = (
        q_keys.join(c_keys, ["job_id", "pair_key"]).select("job_id", "file_id", "reference_id").distinct()
        .join(q, ["job_id", "file_id"]).join(c, ["job_id", "reference_id"])
    )
    hits = F.size(F.filter("c_tokens", lambda t: F.array_contains(F.col("tokens"), t)))
    share = F.when(F.size("c_tokens") > 0, hits / F.size("c_tokens")).otherwise(0.0)
    bonus = 0.25 * (
        F.when((F.col("last_name") != "") & F.array_contains("tokens", F.col("last_name")), 1).otherwise(0)
        + F.when((F.col("year") != "") & F.array_contains("tokens", F.col("year")), 1).otherwise(0)
    )
    jac = P.jaccard(P.shingles(F.col("tokens")), P.shingles(F.col("c_tokens")))
    score = F.when(
        (F.col("title_norm") != "") & F.contains(norm, F.col("title_norm")), 0.95
    ).otherwise(F.least(F.lit(1.0), share * 0.5 + jac * 0.3 + bonus))
    best = (
        pairs.withColumn("score", score)
        .filter("score > 0")
        .groupBy("job_id", "file_id")
        .agg(
            F.max_by(
                F.struct("reference_id", "score"),
                F.struct("score", (-F.col("reference_id")).alias("o")),
            ).alias("b")
        )
    )
    return files.select("job_id", "file_id").join(best, ["job_id", "file_id"], "left").select(
        "job_id",
        "file_id",
        F.when(F.col("b.score") >= TITLE_ACCEPT, F.col("b.reference_id")).alias("reference_id"),
        F.coalesce("b.score", F.lit(0.0)).alias("confidence"),
    )
