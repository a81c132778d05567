"""Word check over documents (as pages) and planted pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from naskah.constants import PREFIX_RULES, SUFFIXES
from naskah.functions import text as T
from naskah.functions import words as W
from naskah.operators import dictionary as D
from naskah.operators import pages as PG
from naskah.operators.words import word_table
from naskah.plans.fixtures import table, view
from naskah.plans.q_rules import ranges_sql
from naskah.plans.registry import query, spans_sql
from naskah.session import materialize

DOCS = "{documents}"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"
_TOKEN = W.TOKEN.replace("'", "''")
# Tokens with running offsets; the gap before a token shows whether a sentence ended.
TOK = f"""SELECT job_id, page_number, txt, CAST(c - length(txt) AS INTEGER) AS s, CAST(c AS INTEGER) AS e, left(nextgap, 1) AS g, left(nextgap, 6) AS g6,
    c = length(txt) OR regexp_matches(gap, '[.!?]\\s+$') AS at_start
  FROM (SELECT *, sum(length(gap) + length(txt)) OVER (PARTITION BY job_id, page_number ORDER BY i) AS c FROM (
    SELECT job_id, page_number, unnest(m) AS txt, unnest(q[1:len(m)]) AS gap, unnest(q[2:len(m) + 1]) AS nextgap, unnest(range(1, len(m) + 1)) AS i
    FROM (SELECT job_id, page_number, regexp_extract_all(text, '{_TOKEN}') AS m, regexp_split_to_array(text, '{_TOKEN}') AS q FROM dp) y) x) z"""
DP = "dp AS (SELECT source AS job_id, doc_id AS page_number, text FROM {documents})"


def doc_pages(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("page_number"),
        F.col("text").alias("content"),
        T.no_ranges().alias("code_ranges"), T.no_ranges().alias("italic_ranges"),
    )


def planted(spark, sf):
    return view(spark, sf, "plant_pages").select(
        "job_id", "page_number", "content",
        T.parse_ranges(F.col("code_json")).alias("code_ranges"),
        T.parse_ranges(F.col("italic_json")).alias("italic_ranges"),
    )


@query(
    "sc3_load_dictionary",
    "SELECT DISTINCT word FROM (SELECT lower(trim(word)) AS word FROM (SELECT ' ' || upper(word) || ' ' AS word FROM {plant_dict} UNION ALL SELECT word FROM {plant_english} UNION ALL SELECT '  ')) WHERE word <> ''",
)
def load_dictionary(spark, sf):
    shouted = view(spark, sf, "plant_dict").select(
        F.concat(F.lit(" "), F.upper("word"), F.lit(" ")).alias("word")
    )
    return D.load_dictionary(shouted, view(spark, sf, "plant_english"))


@query("sc4_load_vocabulary", "SELECT word, classification FROM {plant_vocab}")
def load_vocabulary(spark, sf):
    from naskah.session import scratch_dir

    path = scratch_dir(spark, "vocabulary")
    view(spark, sf, "plant_vocab").select(
        F.initcap("word").alias("word"), "classification", F.lit("catatan").alias("notes")
    ).write.csv(path, sep="\t", header=True)
    return D.load_vocabulary(spark, path)




@query(
    "pf8_structural",
    f"""WITH {DP}, t AS MATERIALIZED ({TOK}), w AS (SELECT txt AS token, at_start, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1, 2)
       SELECT token, at_start, n, regexp_matches(token, '^[A-Z]{{2,}}$') OR (NOT at_start AND regexp_matches(token, '^[A-Z]'))
         OR regexp_matches(token, '[a-z][A-Z]') OR regexp_matches(token, '-$') OR regexp_matches(token, '^[a-z]-[A-Z]')
         OR regexp_matches(token, '(?i)^x{{0,3}}(ix|iv|v?i{{0,3}})$') AS structural FROM w""",
)
def structural(spark, sf):
    c = F.col("content")
    words = doc_pages(spark, sf).select(
        F.explode(
            T.let(
                W.sentence_starts(c),
                lambda st: F.transform(
                    W.token_spans(c),
                    lambda t: F.struct(
                        t["token"].alias("token"), F.array_contains(st, t["offset"]).alias("at_start")
                    ),
                ),
            )
        ).alias("t")
    )
    return (
        words.groupBy("t.token", "t.at_start").agg(F.count("*").alias("n"))
        .withColumn("structural", W.is_structural(F.col("token"), F.col("at_start")))
    )


@query(
    "wn11_sentence_start",
    f"""WITH {DP}, t AS MATERIALIZED ({TOK}) SELECT job_id, page_number, CAST(count(*) FILTER (WHERE at_start) AS BIGINT) AS starts,
        CAST(count(*) AS BIGINT) AS tokens FROM t GROUP BY 1, 2""",
)
def sentence_start(spark, sf):
    c = F.col("content")
    return doc_pages(spark, sf).select(
        "job_id", "page_number",
        T.let(
            W.sentence_starts(c),
            lambda st: F.transform(W.token_spans(c), lambda t: F.array_contains(st, t["offset"])),
        ).alias("flags"),
    ).select(
        "job_id", "page_number",
        F.size(F.filter("flags", lambda f: f)).cast("bigint").alias("starts"),
        F.size("flags").cast("bigint").alias("tokens"),
    ).filter("tokens > 0")


NOUNS = """
  nouns AS (SELECT job_id, lower(txt) AS word FROM t WHERE length(txt) >= 3 GROUP BY 1, 2
    HAVING count(*) FILTER (WHERE regexp_matches(txt, '^[A-Z][a-zà-ÿ]+$')) >= 2 AND count(*) FILTER (WHERE regexp_matches(txt, '^[a-zà-ÿ]+$')) = 0)"""


@query("jn11_proper_nouns", f"WITH {DP}, t AS MATERIALIZED ({TOK}), {NOUNS} SELECT job_id, word FROM nouns")
def proper_nouns(spark, sf):
    return D.proper_nouns(word_table(doc_pages(spark, sf)))


PROBES = """
  nb AS (SELECT *, lead(txt) OVER w AS t2, lead(s) OVER w AS s2, lead(e) OVER w AS e2, lead(g) OVER w AS g2, lead(txt, 2) OVER w AS t3, lead(s, 2) OVER w AS s3
         FROM t WINDOW w AS (PARTITION BY job_id, page_number ORDER BY s)),
  pairs AS (SELECT *, length(txt) + length(t2) AS l2 FROM nb WHERE s2 = e + 1 AND g IN (' ', chr(9))
            AND length(txt) + length(t2) BETWEEN 4 AND 16 AND (length(txt) <= 3 OR length(t2) <= 3)),
  probes AS (
    SELECT job_id, page_number, lower(txt || t2) AS joined, [s, s2] AS offs FROM pairs UNION ALL
    SELECT job_id, page_number, lower(txt || t2 || t3), [s, s2, s3] FROM pairs
    WHERE s3 = e2 + 1 AND g2 IN (' ', chr(9)) AND l2 + length(t3) BETWEEN 5 AND 18 AND length(t2) = 1)"""


@query(
    "wn6_adjacent_tokens",
    f"""WITH {DP}, t AS MATERIALIZED ({TOK}), {PROBES} SELECT job_id, page_number, joined, offs[1] AS "offset", CAST(len(offs) AS INTEGER) AS parts FROM probes""",
)
def adjacent_tokens(spark, sf):
    return D.fragment_probes(word_table(doc_pages(spark, sf))).select(
        "job_id", "page_number", "joined", F.get("offsets", F.lit(0)).alias("offset"), F.size("offsets").alias("parts")
    )


# Breadth-first stems: a node is a (stem, path of rule numbers); levels and paths give the order.
# Patterns are plain prefixes and suffixes here: (rule number, literal, next letter set, put back).
_AZ = "abcdefghijklmnopqrstuvwxyz"


def _rules_sql() -> str:
    out = []
    for n, (pattern, put) in enumerate(PREFIX_RULES):
        body, vowel = pattern[1:], "aeiou" in pattern
        heads = ["me" + c for c in "mnlry"] if "[mnlry]" in body else [body.split("(")[0]]
        out += [f"({n}, '{h}', '{'aeiou' if vowel else _AZ}', '{put.replace(chr(92) + '1', '')}', true)" for h in heads]
    out += [f"({100 + i}, '{x}', '{_AZ}', '', false)" for i, x in enumerate(SUFFIXES)]
    return ", ".join(out)


STEMS = f"""
  rules(n, lit, nxt, put, head) AS (VALUES {_rules_sql()}),
  bfs(word, stem, path, lvl) AS (
    SELECT word, word, CAST([] AS INTEGER[]), 0 FROM wl
    UNION ALL
    SELECT word, CASE WHEN head THEN put || substr(stem, length(lit) + 1) ELSE left(stem, length(stem) - length(lit)) END, list_append(path, n), lvl + 1
    FROM bfs, rules
    WHERE length(stem) > length(lit) AND length(stem) - length(lit) + length(put) >= 2
      AND CASE WHEN head THEN starts_with(stem, lit) AND strpos(nxt, substr(stem, length(lit) + 1, 1)) > 0
               ELSE ends_with(stem, lit) AND strpos(nxt, substr(stem, length(stem) - length(lit), 1)) > 0 END),
  stm AS (SELECT word, stem, row_number() OVER (PARTITION BY word ORDER BY lvl, path) AS pos FROM (
     SELECT *, row_number() OVER (PARTITION BY word, stem ORDER BY lvl, path) AS rn FROM bfs) WHERE rn = 1 AND lvl > 0)"""


@query(
    "tx25_affix_stems",
    f"""WITH RECURSIVE wl AS (SELECT DISTINCT word FROM {{plant_words}}), {STEMS}
      SELECT word, CAST(pos - 1 AS INTEGER) AS pos, stem FROM stm""",
)
def affix_stems(spark, sf):
    words = view(spark, sf, "plant_words").select("word").distinct()
    return words.select("word", F.posexplode(D.stems(F.col("word"))).alias("pos", "stem"))


def lookup_sql(words: str) -> str:
    """The whole cascade for ``words`` (a select of one column), ending in ``verdicts``."""
    return f"""
  wl AS ({words}),
  fresh AS (SELECT word, bool_or(found) AS found FROM {{plant_answers}} WHERE epoch_us({NOW}) - epoch_us(fetched_at) <= 900000000 GROUP BY 1),
  {STEMS},
  pb AS (
    SELECT word, 0 AS rank, word AS probe, 'v' AS via FROM wl UNION ALL
    SELECT word, 1, left(word, (length(word) - 1) // 2), 'vd' FROM wl
      WHERE length(word) % 2 = 1 AND substr(word, (length(word) + 1) // 2, 1) = '-' AND left(word, (length(word) - 1) // 2) = right(word, (length(word) - 1) // 2)
        AND length(word) >= 5 UNION ALL
    SELECT word, 3, word, 'd' FROM wl UNION ALL
    SELECT word, pos + 3, stem, 'vd' FROM stm),
  hit AS (SELECT pb.word, arg_min(CASE WHEN via <> 'd' AND v.classification IS NOT NULL THEN v.classification ELSE '-' END, rank) AS hit
    FROM pb LEFT JOIN {{plant_vocab}} v ON v.word = probe LEFT JOIN {{plant_dict}} d ON d.word = probe
    WHERE (via <> 'd' AND v.word IS NOT NULL) OR (via <> 'v' AND d.word IS NOT NULL) GROUP BY 1),
  verdicts AS (SELECT wl.word,
      CASE WHEN hit = '-' THEN true WHEN hit IS NOT NULL THEN hit <> 'typo' WHEN found THEN true WHEN en.word IS NOT NULL THEN true ELSE false END AS known,
      CASE WHEN hit IS NOT NULL THEN true WHEN found THEN false WHEN en.word IS NOT NULL THEN true WHEN found IS NOT NULL THEN false ELSE true END AS database_only,
      coalesce(CASE WHEN hit IS NOT NULL THEN hit IN ('english', 'tech') WHEN found THEN false ELSE en.word IS NOT NULL END, false) AS is_english,
      CASE WHEN hit = '-' THEN 'local-database' WHEN hit IS NOT NULL THEN 'user-vocabulary' WHEN found THEN 'kbbi-online'
           WHEN en.word IS NOT NULL THEN 'english-list' WHEN found IS NOT NULL THEN 'kbbi-online' ELSE 'unverified' END AS source,
      CASE WHEN hit IS NULL AND found IS NULL AND en.word IS NULL THEN 'unverified' ELSE 'local' END AS tier
    FROM wl LEFT JOIN hit USING (word) LEFT JOIN fresh USING (word) LEFT JOIN {{plant_english}} en ON en.word = wl.word)"""


def lexicons(spark, sf):
    counts = materialize(view(spark, sf, "plant_counts"), "word-counts")
    held = lambda name: view(spark, sf, name, plant_counts=counts)
    answers = D.fresh_answers(held("plant_answers"), F.lit("2024-02-01 00:00:00").cast("timestamp"), 900)
    return dict(
        dictionary=held("plant_dict"), vocabulary=held("plant_vocab"), answers=answers, english=held("plant_english"),
    )


DISTINCT_WORDS = "SELECT DISTINCT word FROM {plant_words} UNION SELECT DISTINCT word || '-' || word FROM {plant_words} WHERE length(word) = 4"


@query("jn7_lookup_words", f"WITH RECURSIVE {lookup_sql(DISTINCT_WORDS)} SELECT * FROM verdicts")
def lookup_words(spark, sf):
    words = view(spark, sf, "plant_words").select("word").distinct()
    doubled = words.filter("length(word) = 4").select(F.concat_ws("-", "word", "word").alias("word"))
    return D.lookup_words(words.unionByName(doubled), **lexicons(spark, sf))


@query(
    "st5_fresh_answers",
    f"SELECT word, found, fetched_at FROM {{plant_answers}} WHERE epoch_us({NOW}) - epoch_us(fetched_at) <= 900000000",
)
def fresh_answers(spark, sf):
    return lexicons(spark, sf)["answers"]


# Links are the only skip ranges that documents may hold.
_LINKS = W.URL_WIDE.replace("'", "''")
CANDS = f"""{DP}, t AS MATERIALIZED ({TOK}), {NOUNS}, {PROBES},
  links AS ({spans_sql("dp", "job_id, page_number", "text", W.URL_WIDE, "i")}),
  redup_raw AS (SELECT a.job_id, a.page_number, a.s, b.s AS sb FROM nb a JOIN nb b ON b.job_id = a.job_id AND b.page_number = a.page_number AND b.s = a.s2 AND lower(a.txt) = lower(b.txt)
     AND length(a.txt) >= 2 AND regexp_matches(left(a.g6, b.s - a.e), '^\\s*-\\s*$')),
  pw AS (SELECT job_id, page_number, s, txt, lower(txt) AS word FROM t
     WHERE length(txt) >= 2 AND NOT (regexp_matches(txt, '^[A-Z]{{2,}}$') OR (NOT at_start AND regexp_matches(txt, '^[A-Z]'))
         OR regexp_matches(txt, '[a-z][A-Z]') OR regexp_matches(txt, '-$') OR regexp_matches(txt, '^[a-z]-[A-Z]')
         OR regexp_matches(txt, '(?i)^x{{0,3}}(ix|iv|v?i{{0,3}})$'))
       AND NOT EXISTS (SELECT 1 FROM links l WHERE l.job_id = t.job_id AND l.page_number = t.page_number AND t.s < l.e AND t.e > l.s)
       AND NOT EXISTS (SELECT 1 FROM redup_raw r WHERE r.job_id = t.job_id AND r.page_number = t.page_number AND t.s IN (r.s, r.sb)))"""
ALL_WORDS = "SELECT DISTINCT word FROM pw UNION SELECT DISTINCT joined FROM probes"
CHECK = f"""{CANDS}, {lookup_sql(ALL_WORDS)},
  frag AS (SELECT DISTINCT job_id, page_number, unnest(offs) AS o FROM probes JOIN verdicts v ON v.word = joined WHERE v.known),
  left_words AS (SELECT * FROM pw WHERE NOT EXISTS (SELECT 1 FROM frag f WHERE f.job_id = pw.job_id AND f.page_number = pw.page_number AND f.o = pw.s)
     AND NOT EXISTS (SELECT 1 FROM nouns n WHERE n.job_id = pw.job_id AND n.word = pw.word)),
  cands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page_number, word ORDER BY s) AS rn FROM left_words) WHERE rn = 1)"""


def word_check(spark, sf):
    return D.check_words(doc_pages(spark, sf), **lexicons(spark, sf))


def checked(spark, sf):
    """(word check, its dictionary, external answers)."""
    lists = lexicons(spark, sf)
    return D.check_words(doc_pages(spark, sf), **lists), lists["dictionary"], view(spark, sf, "plant_external")


@query("jn10_known_fragments", f"WITH RECURSIVE {CHECK} SELECT job_id, page_number, CAST(o AS INTEGER) AS \"offset\" FROM frag")
def known_fragments(spark, sf):
    probes = materialize(D.fragment_probes(word_table(doc_pages(spark, sf), flags=False)), "probes")
    verdicts = D.lookup_words(probes.select(F.col("joined").alias("word")), **lexicons(spark, sf))
    return D.known_fragments(probes, verdicts)


@query("wn4_first_occurrence", f"WITH RECURSIVE {CHECK} SELECT job_id, page_number, word, s AS \"offset\", txt AS token FROM cands")
def first_occurrence(spark, sf):
    return word_check(spark, sf).candidates.select("job_id", "page_number", "word", "offset", "token")


OPEN = """SELECT job_id, word, page_number, s, row_number() OVER (PARTITION BY job_id ORDER BY page_number, s, word) AS r FROM (
          SELECT *, row_number() OVER (PARTITION BY job_id, word ORDER BY page_number, s) AS k FROM cands JOIN verdicts USING (word) WHERE source = 'unverified') WHERE k = 1"""
BUDGET = 300
# Candidates after the external answers that the budget of their job allows.
ANSWERED = f"""{CHECK}, ow AS MATERIALIZED ({OPEN}),
  ans AS (SELECT ow.*, found FROM ow JOIN {{plant_external}} USING (word) WHERE r <= {BUDGET}),
  rc AS MATERIALIZED (SELECT c.job_id, c.page_number, c.s, c.txt, c.word, coalesce(a.found, v.known) AS known,
      a.found IS NULL AND v.database_only AS database_only, CASE WHEN a.found IS NULL THEN v.source ELSE 'kbbi-online' END AS source,
      CASE WHEN a.found IS NULL THEN v.tier WHEN a.page_number = c.page_number AND a.s = c.s THEN 'daring' ELSE 'local' END AS tier
    FROM cands c JOIN verdicts v USING (word) LEFT JOIN ans a ON a.job_id = c.job_id AND a.word = c.word)"""


def answered_words(spark, sf):
    return D.with_external(word_check(spark, sf), view(spark, sf, "plant_external"), BUDGET)


_TIERS = ", ".join(f"CAST(count(*) FILTER (WHERE tier = '{t}') AS BIGINT) AS {t}" for t in ("local", "daring", "unverified"))


@query("ag7_tier_counts", f"WITH RECURSIVE {ANSWERED} SELECT job_id, {_TIERS}, CAST(count(*) AS BIGINT) AS total FROM rc GROUP BY 1")
def tier_counts(spark, sf):
    return D.tier_counts(answered_words(spark, sf), "job_id")


@query("ag7_tier_totals", f"WITH RECURSIVE {ANSWERED} SELECT {_TIERS}, CAST(count(*) AS BIGINT) AS total FROM rc")
def tier_totals(spark, sf):
    """Over all jobs of the corpus."""
    return D.tier_counts(answered_words(spark, sf))


SUGGESTED = """sug AS (SELECT word, suggestion FROM (
    SELECT w.word, d.word AS suggestion, row_number() OVER (PARTITION BY w.word ORDER BY levenshtein(ascii_word, d.word), d.word) AS rn
    FROM (SELECT DISTINCT word, regexp_replace(word, '[^\\x00-\\x7F]', '#', 'g') AS ascii_word FROM rc WHERE NOT known) w
    JOIN {plant_dict} d ON left(d.word, 1) = left(w.word, 1) AND abs(length(d.word) - length(w.word)) <= 2
    WHERE length(w.word) BETWEEN 3 AND 20 AND levenshtein(ascii_word, d.word) <= CASE WHEN length(w.word) <= 5 THEN 1 ELSE 2 END) WHERE rn = 1)"""


@query(
    "jn8_unknown_words",
    f"""WITH RECURSIVE {ANSWERED}, {SUGGESTED} SELECT job_id, page_number, s AS "offset", CAST(length(txt) AS INTEGER) AS length, txt AS token, word,
        CASE WHEN database_only THEN 'kbbi.unknown-word.database-only' ELSE 'kbbi.unknown-word' END AS rule_id,
        CASE WHEN source = 'kbbi-online' THEN 'kbbi-daring' ELSE 'basis-data' END AS verification_source,
        CASE WHEN source = 'kbbi-online' THEN 'Kata "' || txt || '" tidak ditemukan di basis data lokal maupun KBBI daring — mungkin istilah teknis/asing, nama, atau salah ketik.'
        ELSE 'Kata "' || txt || '" belum dapat diverifikasi ke KBBI daring (sumber sedang sibuk atau tidak menjawab). Sejauh ini hanya diperiksa di basis data lokal — mungkin istilah teknis/asing, nama, atau salah ketik.' END AS message,
        suggestion
        FROM rc LEFT JOIN sug USING (word) WHERE NOT known""",
)
def unknown_words(spark, sf):
    check, dictionary, external = checked(spark, sf)
    unknown = materialize(D.with_external(check, external, BUDGET).filter("NOT known"), "unknown")
    return D.unknown_words(unknown, D.suggest(unknown, dictionary))


@query(
    "wn7_within_budget",
    f"WITH RECURSIVE {CHECK}, ow AS ({OPEN}) SELECT job_id, word, page_number, s AS \"offset\" FROM ow WHERE r <= 300",
)
def within_budget(spark, sf):
    check = word_check(spark, sf)
    return D.within_budget(check.candidates, check.verdicts, 300)


@query(
    "wn7_resolve_external",
    f"""WITH RECURSIVE {CHECK}, ow AS MATERIALIZED ({OPEN}),
      b(budget) AS (VALUES (0), (1), (50)),
      ans AS (SELECT budget, ow.*, found FROM b JOIN ow ON budget = 0 OR r <= budget JOIN {{plant_external}} USING (word))
      SELECT budget, c.job_id, CAST(count(*) FILTER (WHERE c.page_number = a.page_number AND c.s = a.s) AS BIGINT) AS asked,
        CAST(count(*) FILTER (WHERE c.page_number <> a.page_number OR c.s <> a.s) AS BIGINT) AS stored,
        CAST(count(*) FILTER (WHERE found) AS BIGINT) AS found, CAST(sum(c.page_number * 1000 + c.s) AS BIGINT) AS places
      FROM ans a JOIN cands c ON c.job_id = a.job_id AND c.word = a.word GROUP BY 1, 2""",
)
def resolve_external(spark, sf):
    """Answers and stored answers of each job with no, the smallest and a larger budget."""
    check = word_check(spark, sf)
    # only open words can be asked for; their sources are all 'unverified' before
    check = check._replace(candidates=check.candidates.filter("source = 'unverified'"))
    out = None
    for budget in (0, 1, 50):
        part = (
            D.with_external(check, view(spark, sf, "plant_external"), budget)
            .filter("source = 'kbbi-online'")
            .groupBy(F.lit(budget).alias("budget"), "job_id")
            .agg(
                F.count_if(F.col("tier") == "daring").alias("asked"), F.count_if(F.col("tier") == "local").alias("stored"),
                F.count_if("known").alias("found"), F.sum(F.col("page_number") * 1000 + F.col("offset")).alias("places"),
            )
        )
        out = part if out is None else out.unionByName(part)
    return out


UNKNOWN = "(SELECT DISTINCT word FROM {plant_words} EXCEPT SELECT word FROM {plant_dict})"


@query(
    "jn9_suggest",
    f"""SELECT word, suggestion, CAST(d AS INTEGER) AS distance FROM (
        SELECT w.word, d.word AS suggestion, levenshtein(w.word, d.word) AS d,
          row_number() OVER (PARTITION BY w.word ORDER BY levenshtein(w.word, d.word), d.word) AS rn
        FROM {UNKNOWN} w JOIN {{plant_dict}} d ON left(d.word, 1) = left(w.word, 1) AND abs(length(d.word) - length(w.word)) <= 2
        WHERE length(w.word) BETWEEN 3 AND 20 AND levenshtein(w.word, d.word) <= CASE WHEN length(w.word) <= 5 THEN 1 ELSE 2 END) WHERE rn = 1""",
)
def suggest(spark, sf):
    dictionary = view(spark, sf, "plant_dict")
    unknown = view(spark, sf, "plant_words").select("word").distinct().join(dictionary, "word", "left_anti")
    return D.suggest(unknown, dictionary)


@query(
    "jn12_italic_words",
    f"""WITH r AS (SELECT job_id, page_number, content, unnest({ranges_sql('italic_json')}) AS r FROM {{plant_pages}}),
      w AS (SELECT job_id, page_number, unnest(regexp_extract_all(substr(content, r[1] + 1, r[2] - r[1]), '{_TOKEN}')) AS w FROM r)
      SELECT DISTINCT job_id, page_number, lower(w) AS word FROM w WHERE length(w) >= 2""",
)
def italic_words(spark, sf):
    return planted(spark, sf).select(
        "job_id", "page_number", F.explode(W.italic_words(F.col("content"), F.col("italic_ranges"))).alias("word")
    )


@query(
    "tx26_redup_base",
    """WITH w AS (SELECT DISTINCT word AS base FROM {plant_words} WHERE length(word) BETWEEN 3 AND 6),
      v AS (SELECT base || '-' || base AS word, base AS plain, base AS affixed FROM w
            UNION ALL SELECT 'xq' || base || '-' || base || 'zz', NULL, NULL FROM w
            UNION ALL SELECT base || '-x' || base, NULL, NULL FROM w)
      SELECT word, plain, affixed FROM v WHERE word NOT LIKE 'xq%' """,
)
def redup_base(spark, sf):
    base = view(spark, sf, "plant_words").select("word").distinct().filter(F.length("word").between(3, 6))
    w = F.col("word")
    both = base.select(F.concat_ws("-", w, w).alias("word")).unionByName(
        base.select(F.concat(w, F.lit("-x"), w).alias("word"))
    )
    return both.select("word", W.redup_base(w).alias("plain"), W.redup_affixed_base(w).alias("affixed"))


@query(
    "tx27_redup_offsets",
    """WITH t AS (SELECT job_id, page_number, content, strpos(content, 'ciri - ciri') AS a, strpos(content, 'anak- anak') AS b, strpos(content, 'rumah-rumah') AS c,
         strpos(content, 'hal-hal') AS d FROM {plant_pages}),
      o AS (SELECT job_id, page_number, unnest([a - 1, a + 6]) AS o FROM t WHERE a > 0 UNION ALL SELECT job_id, page_number, unnest([b - 1, b + 5]) FROM t WHERE b > 0
       UNION ALL SELECT job_id, page_number, unnest([c - 1, c + 5]) FROM t WHERE c > 0 UNION ALL SELECT job_id, page_number, unnest([d - 1, d + 3]) FROM t WHERE d > 0)
      SELECT job_id, page_number, CAST(o AS INTEGER) AS "offset" FROM o""",
)
def redup_offsets(spark, sf):
    return view(spark, sf, "plant_pages").select(
        "job_id", "page_number", F.explode(W.redup_offsets(F.col("content"))).alias("offset")
    )


def _span_sel(pattern: str, flags: str = "") -> str:
    return f"SELECT job_id, page_number, s, e FROM ({spans_sql('{plant_pages}', 'job_id, page_number', 'content', pattern, flags)})"


@query(
    "tx28_skip_ranges",
    "SELECT job_id, page_number, s AS start, e AS \"end\" FROM ("
    + " UNION ALL ".join([_span_sel(W.URL_WIDE, "i"), _span_sel(W.ET_AL, "i"), _span_sel(W.PAREN_CITATION), _span_sel(W.AUTHOR_YEAR)])
    + ")",
)
def skip_ranges(spark, sf):
    return view(spark, sf, "plant_pages").select(
        "job_id", "page_number", F.explode(W.skip_ranges(F.col("content"))).alias("r")
    ).select("job_id", "page_number", "r.start", "r.end")


@query(
    "pf10_leader_runs",
    f"""SELECT job_id, page_number, CAST(len(regexp_extract_all(content, '{PG.LEADER_RUN}')) AS INTEGER) AS leader_runs,
        regexp_matches(content, '(?i){PG.LISTING_HEADING}') AS has_heading FROM {{plant_pages}}""",
)
def leader_runs(spark, sf):
    c = F.col("content")
    return view(spark, sf, "plant_pages").select(
        "job_id", "page_number", PG.leader_runs(c).alias("leader_runs"), PG.has_listing_heading(c).alias("has_heading")
    )


LISTING = f"""
  fx AS (SELECT job_id, page_number, len(regexp_extract_all(content, '{PG.LEADER_RUN}')) AS runs, regexp_matches(content, '(?i){PG.LISTING_HEADING}') AS head FROM {{plant_pages}}),
  st AS (SELECT *, CASE WHEN head THEN runs >= 1 WHEN runs >= 3 THEN true WHEN runs = 0 THEN false END AS own FROM fx),
  ls AS (SELECT job_id, page_number, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY page_number), false) AS is_listing FROM st)"""


@query("wn2_listing_pages", f"WITH {LISTING} SELECT job_id, page_number, is_listing FROM ls")
def listing_pages(spark, sf):
    return PG.listing_pages(view(spark, sf, "plant_pages")).select("job_id", "page_number", "is_listing")


BOUNDS = r"""
  bd AS (SELECT job_id, coalesce(min(page_number) FILTER (WHERE regexp_matches(content, '(?i)\bBAB\s*1\b')), min(page_number)) AS start_page,
     max(page_number) FILTER (WHERE regexp_matches(content, '(?i)\bDAFTAR\s+(REFERENSI|PUSTAKA)\b')
       AND NOT (regexp_matches(content, '\.{6,}') AND regexp_matches(content, '(?s)\bBAB\s+\d+\b.*\bBAB\s+\d+\b'))) AS refs_page FROM {plant_pages} GROUP BY 1)"""


@query("wn3_body_pages", f"WITH {BOUNDS} SELECT p.job_id, p.page_number FROM {{plant_pages}} p JOIN bd USING (job_id) WHERE page_number >= start_page AND (refs_page IS NULL OR page_number < refs_page)")
def body_pages(spark, sf):
    return PG.body_pages(view(spark, sf, "plant_pages")).select("job_id", "page_number")
