"""Inputs that the registered queries derive from the given tables.

Each view is one SQL text that Spark and DuckDB both run, so a query and its
oracle start from the same rows. A view may name tables and other views as ``{name}``.
Every view reads its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType

NL = "chr(10)"
SURNAMES = [
    "Santoso", "Wijaya", "Hidayat", "Nugroho", "Pratama", "Kusuma",
    "Saputra", "Lestari", "Rahmawati", "Al-Azawi", "Müller", "Siregar",
]
# The same names with one letter changed, doubled or dropped.
MISSPELT = [
    "Santozo", "Wijayaa", "Hidaya", "Nugrohoo", "Pratamo", "Kusumo",
    "Saputro", "Lestary", "Rahmwati", "Al-Azawy", "Muller", "Siregir",
]
TITLES = [
    "Analisis kinerja sistem informasi akademik",
    "Rancang bangun aplikasi pembelajaran daring",
    "Evaluation of network security in schools",
    "Penerapan metode pengujian perangkat lunak",
    "Data mining",
    "A study of information retrieval models",
    "Klasifikasi citra dengan jaringan saraf",
]

# One or more hits per orthography rule, near misses beside them.
RULE_SENTENCES = [
    "Kata ini  memiliki dua spasi dan kata   itu tiga, tetapi 12  34 tidak.",
    "Harga naik  , lalu turun   ! Gambar  ......... 7 dan satu spasi . saja.",
    "Penelitian selesai,kemudian ditutup;lalu a,b dan 3,5 dibiarkan.",
    "Benarkah demikian?? Tentu saja!!! Ya,, begitu; selesai: ya.",
    "Jadi begini.. lalu begitu.... titik ... dan.......akhir..... cukup.",
    "Nilainya 1,000.50 rupiah dan 12,345,678 unit, bukan 12,5 atau 1234,567 persen.",
    "Mereka dirumah dan dikantor. Dimana saja? Bukan dimakan atau di rumah.",
    "Kemana mereka pergi? kemana saja, bukan kemanakah atau ke mana.",
    "Lebih dari  pada itu, ke pada dia, Bagai mana cara, ke tika malam, daripada, kepada.",
    "Baca lah buku itu, apa kah benar, entah tah, lah sudah, bacalah.",
    "Diapun datang walaupun sakit, merekapun pulang, adapun itu, pun begitu.",
    "Buku di baca, di lakukan, di rumah, di atas, di gunakannya, di tampilkan, Di tulis, di ikan.",
    "Kalimat ini sudah benar di rumah, walaupun hanya satu... titik.",
    "Metode TDD dan CRUD dipakai pada BAB IV. Rapid Application Development (RAD) dan RAD, HTTP, SISTEM.",
    "Lihat https://contoh.ac.id/kata,kata dan www.uji.com/aa..bb untuk rincian.",
    "Ada ciri - ciri umum, anak- anak kecil, rumah-rumah besar, berlari-larian, hal-hal.",
    "Pakai framework yang modern dan Testing software itu bagus, bukan aplikasi.",
    "Hasil penelitan mengunakan metoda pembelajaran kuantitatif  dan sis tem.",
]

# {a} {b} {c} authors, {y} {z} years.
CITATION_SENTENCES = [
    "Menurut {a} ({y}), hal ini benar.",
    "Hal ini penting ({a}, {y}). Lalu dibahas lagi.",
    "Hasilnya sama ({a} & {b}, {y}; {c}, {z}, hlm. 42-45).",
    "Seperti dijelaskan ({a} et al., {y}; {b} dan {c}, {z}; {a} et al., {y}).",
    "Menurut {a} dan {b} ({y}, p. 7) keadaan ini biasa.",
    "Tabel ({y}) menunjukkan hasil dan Gambar ({z}) juga.",
    "Grade Students Using Android Learning ({y}) adalah judul.",
    "Perhatikan (lihat {a} dkk., {y}a) untuk rincian.",
    "Rincian ada (dikutip dari {a}, {b}, & {c}, {y}) dan lainnya.",
    "{a}" + "\n" + "{b} ({y}) adalah baris tabel.",
    "Tidak ada kutipan ({y}) di sini (lihat bab 2).",
]

# {a} {b} authors, {y} year, {t} title, {k} number.
ENTRY_STYLES = [
    "{a}, B. C., & {b}, D. ({y}). {t}. Jurnal Teknik, 12(3), 45-67. https://doi.org/10.1234/jt.{k}",
    "{a}, F. and {b}, G., {y}. {t}. Jakarta: Penerbit Andi. Tersedia di https://contoh.org/buku/{k}",
    "{a}, H. {y}. {t}. Bandung: Informatika.",
    "{a}, I., {b}, J. ({y}). {t}. Vol. 4, diakses https://doi.org/10.5555/ab" + "\n" + "cd.{k}",
    "{a} ({y}) '{t}', Prosiding Seminar {k}.",
]


def lit(text: str) -> str:
    """A SQL string expression for ``text`` without backslashes or doubled quotes."""
    parts = []
    for piece in re.split(r"([\n'])", text):
        if piece == "\n":
            parts.append(NL)
        elif piece == "'":
            parts.append("chr(39)")
        elif piece:
            parts.append(f"'{piece}'")
    return " || ".join(parts) or "''"


def template(text: str, **exprs: str) -> str:
    """``lit`` with ``{name}`` replaced by SQL expressions."""
    parts = []
    for piece in re.split(r"(\{\w+\})", text):
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(exprs[piece[1:-1]])
        elif piece:
            parts.append(lit(piece))
    return " || ".join(parts)


def pick(index: str, options: list[str]) -> str:
    """CASE over ``index`` modulo the number of (already SQL) options."""
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE ({index}) % {len(options)} {whens} END"


def name(index: str, options: list[str] = SURNAMES) -> str:
    return pick(index, [lit(o) for o in options])


_CITES = [
    template(s, a="a1", b="a2", c="a3", y="y1", z="y2") for s in CITATION_SENTENCES
]
_RULES = [lit(s) for s in RULE_SENTENCES]
_ENTRY = [template(s, a="a1", b="a2", y="y1", t="t1", k="CAST(k AS VARCHAR(20))") for s in ENTRY_STYLES]

_TOC = lit(
    "DAFTAR ISI\nBAB 1 PENDAHULUAN .......... 1\nBAB 2 TEORI . . . . . . 5\nDAFTAR PUSTAKA ........ 9"
)
_TOC_TAIL = lit("Lampiran lanjutan\nTabel 1 Hasil uji ........ 12")

VIEWS: dict[str, str] = {
    # A page per order; the customer's orders are one document.
    "plant_base": """
        SELECT 'J' || CAST(o_custkey AS VARCHAR(20)) AS job_id, o_orderkey AS k,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS n,
               CAST(count(*) OVER (PARTITION BY o_custkey) AS INT) AS total,
               CAST(year(o_orderdate) AS VARCHAR(4)) AS y1,
               CAST(year(o_orderdate) + 1 AS VARCHAR(4)) AS y2,
               %s AS a1, %s AS a2, %s AS a3, %s AS t1
        FROM {orders}
    """ % (
        name("o_orderkey"), name("o_orderkey * 5 + 1"), name("o_orderkey * 7 + 2"),
        name("o_orderkey * 3", TITLES),
    ),
    "plant_text": f"""
        SELECT job_id, n AS page_number, k, total,
               CASE WHEN n = 1 THEN {_TOC}
                    WHEN n = 2 AND k % 2 = 0 THEN {_TOC_TAIL}
                    WHEN total >= 5 AND n = total - 1 THEN
                      'Universitas Contoh' || {NL} || n || {NL} || 'DAFTAR PUSTAKA' || {NL} || e1 || {NL} || e2
                      || {NL} || {NL} || e3
                    WHEN total >= 5 AND n = total THEN
                      'Universitas Contoh' || {NL} || n || {NL} || e4 || {NL} || e5
                    ELSE CASE WHEN n = 3 THEN 'BAB 1 PENDAHULUAN' || {NL} ELSE '' END
                      || s1 || ' ' || c1 || ' ' || s2 || {NL} || c2 || ' ' || s3 END AS content
        FROM (
          SELECT job_id, n, k, total,
                 {pick("k", _RULES)} AS s1, {pick("k * 5 + 7", _RULES)} AS s2, {pick("k * 11 + 3", _RULES)} AS s3,
                 {pick("k", _CITES)} AS c1, {pick("k * 3 + 4", _CITES)} AS c2,
                 {pick("k", _ENTRY)} AS e1, {pick("k + 1", _ENTRY)} AS e2, {pick("k + 2", _ENTRY)} AS e3,
                 {pick("k + 3", _ENTRY)} AS e4, {pick("k + 4", _ENTRY)} AS e5
          FROM {{plant_base}}
        ) x
    """,
    # Ranges as stored JSON text, some of it malformed.
    "plant_pages": """
        SELECT job_id, page_number, content,
               CASE k % 5 WHEN 0 THEN '[[0,20],[40,60]]' WHEN 1 THEN 'oops' WHEN 2 THEN '[]'
                    WHEN 3 THEN CAST(NULL AS VARCHAR(20)) ELSE '[[5,9]]' END AS code_json,
               CASE k % 7 WHEN 0 THEN '[[10,45]]' WHEN 1 THEN '{"a":1}' WHEN 2 THEN '[[60,90],[100,104]]'
                    ELSE '[]' END AS italic_json
        FROM {plant_text}
    """.replace('{"a":1}', 'x,y'),
    # A reference per order, with typos, year shifts, several authors and n.d.
    "plant_refs": f"""
        SELECT job_id, k AS reference_id,
               CASE k % 6 WHEN 0 THEN a1 || ', B.'
                          WHEN 1 THEN {name("k", MISSPELT)} || ', B. C.'
                          WHEN 2 THEN a1 || ', B., ' || a2 || ', C., & ' || a3 || ', D.'
                          WHEN 3 THEN 'Komunitas ' || a1
                          WHEN 4 THEN a1 || ', A. dan ' || a2 || ', E.'
                          ELSE 'Z' || a1 || 'xyz, Q.' END AS author,
               CASE WHEN k % 11 = 0 THEN 'n.d.'
                    ELSE CAST(CAST(y1 AS INT) + CAST(k % 5 AS INT) - 2 AS VARCHAR(4)) END AS year,
               t1 AS title
        FROM {{plant_base}}
    """,
    # One bibliography entry per order, plus forms without year, author or link.
    "plant_entries": f"""
        SELECT k AS entry_id, CASE k % 13
            WHEN 11 THEN 'Tanpa tahun dan tanpa pengarang, hanya teks panjang.'
            WHEN 12 THEN 'catatan doi: 10.1000/abc.' || k || '). Lihat http://a.b/c, http://doi.org/10.1/x tahun 2021 saja'
            ELSE {pick("k", _ENTRY)} END AS raw_text
        FROM {{plant_base}}
    """,
    # Uploaded files whose title or first page holds a reference of the job, or nothing.
    "plant_files": f"""
        SELECT job_id, k AS file_id,
               CASE k % 4 WHEN 0 THEN t1 || ' (' || y1 || ')' WHEN 1 THEN '' WHEN 2 THEN 'dokumen ' || a2 || ' ' || y1
                    ELSE 'scan0001' END AS title,
               CASE k % 3 WHEN 0 THEN 'Oleh ' || a1 || ' tahun ' || y1 || ' tentang ' || t1
                    WHEN 1 THEN '' ELSE 'bigdata mining ' || a3 END AS first_page
        FROM {{plant_base}}
    """,
    # A context per benchmark text, searched in one source; some lack keywords altogether.
    "passage_queries": """
        SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS VARCHAR(10)) AS source_id,
               CASE WHEN item_id % 9 = 4 THEN lower(text)
                    WHEN item_id % 5 = 1 THEN text || ' (Santoso, 2020).' ELSE text END AS context
        FROM {benchmark}
    """,
    # Words of all documents, and word lists taken from their frequencies.
    "plant_words": """
        SELECT doc_id, source AS job_id, @words(text)@ AS word FROM {documents}
    """,
    "plant_counts": "SELECT word, count(*) AS n FROM {plant_words} GROUP BY word",
    "plant_dict": "SELECT word FROM {plant_counts} WHERE length(word) >= 2 AND n >= 20",
    "plant_vocab": """
        SELECT word, CASE length(word) % 6 WHEN 0 THEN 'indonesian' WHEN 1 THEN 'english' WHEN 2 THEN 'tech'
               WHEN 3 THEN 'brand' WHEN 4 THEN 'ignore' ELSE 'typo' END AS classification
        FROM {plant_counts} WHERE length(word) >= 4 AND n BETWEEN 17 AND 22
    """,
    "plant_english": "SELECT word FROM {plant_counts} WHERE length(word) >= 4 AND n BETWEEN 10 AND 13",
    "plant_answers": """
        SELECT word, length(word) % 2 = 0 AS found,
               CASE WHEN length(word) % 5 = 0 THEN TIMESTAMP '2024-01-31 23:44:59' ELSE TIMESTAMP '2024-01-31 23:45:00' END AS fetched_at
        FROM {plant_counts} WHERE length(word) >= 3 AND n BETWEEN 6 AND 11
    """,
    # What the online dictionary would answer; some words get no answer.
    "plant_external": """
        SELECT word, length(word) % 3 = 0 AS found FROM {plant_counts}
        WHERE length(word) >= 3 AND length(word) % 4 <> 1 AND n <= 16
    """,
    # Calls: outcome by event type, host and provider by user.
    "call_log": """
        SELECT event_id AS id, ts AS created_at,
               CASE user_id % 5 WHEN 0 THEN 'crossref' WHEN 1 THEN 'openalex' WHEN 2 THEN 'unpaywall' WHEN 3 THEN 'arxiv' ELSE 'kbbi' END AS provider,
               'h' || CAST(user_id % 7 AS VARCHAR(5)) || '.example.org' AS host,
               'https://h' || CAST(user_id % 7 AS VARCHAR(5)) || '.example.org/' || CASE event_id % 3 WHEN 0 THEN 'A_b/' WHEN 1 THEN 'aXb/' ELSE '50%/' END || CAST(event_id AS VARCHAR(20)) AS url,
               CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'http_error' WHEN 'signup' THEN 'network_error' WHEN 'error' THEN 'timeout' ELSE 'aborted' END AS outcome,
               CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 500 END END AS status,
               CASE event_id % 3 WHEN 0 THEN '900' WHEN 1 THEN 'soon' END AS retry_after,
               CAST(floor(value * 10) AS INT) AS duration_ms,
               CASE WHEN event_id % 4 = 0 THEN 'T' || CAST(user_id AS VARCHAR(20)) END AS track_job_id,
               CASE WHEN event_id % 4 = 1 THEN 'E' || CAST(user_id AS VARCHAR(20)) END AS eval_job_id
        FROM {events}
    """,
    "plant_jobs": """
        SELECT 'B' || CAST(event_id AS VARCHAR(20)) AS job_id,
               CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'extracting' WHEN 2 THEN 'analyzing' WHEN 3 THEN 'done' ELSE 'failed' END AS status,
               CASE WHEN event_id % 3 = 0 THEN ts END AS heartbeat_at, ts AS updated_at, ts - INTERVAL '45' MINUTE AS created_at,
               CAST(event_id % 6 AS INT) AS attempts
        FROM {events}
    """,
    "plant_orders": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS job_id, 'berkas_v' || CAST(o_orderkey % 9 AS VARCHAR(5)) || '.pdf' AS filename,
               CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'extracting' ELSE 'failed' END AS status,
               CASE o_orderkey % 4 WHEN 0 THEN 'review-passages' WHEN 1 THEN 'upload-sources' WHEN 2 THEN 'review-matches' ELSE 'upload' END AS phase,
               o_orderdate AS created_at, o_orderdate + INTERVAL '40' DAY AS updated_at,
               CASE WHEN o_orderkey % 10 <> 3 THEN CAST(o_orderkey % 120 AS INT) END AS total_pages
        FROM {orders}
    """,
    "plant_sources": """
        SELECT job_id, reference_id, reference_id * 10 AS source_id, 'f' || CAST(reference_id AS VARCHAR(20)) || '.pdf' AS filename,
               CASE reference_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'downloading' WHEN 3 THEN 'extracting' ELSE 'done' END AS status,
               o_orderdate AS updated_at
        FROM {plant_refs} JOIN {orders} ON o_orderkey = reference_id WHERE reference_id % 5 <> 2
    """,
    "plant_attempts": """
        SELECT l_orderkey AS reference_id, CAST(l_linenumber AS INT) AS rank, 'p' || CAST(l_linenumber AS VARCHAR(5)) AS provider,
               'https://s.example.org/' || CAST(l_partkey % 3 AS VARCHAR(5)) AS url,
               l_suppkey % 4 = 0 AS ok, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'HTTP ' || CAST(400 + l_suppkey % 4 AS VARCHAR(5)) END AS error
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x
    """,
    "plant_listing": """
        SELECT 'file:/up/' || CASE o_orderkey % 5 WHEN 0 THEN 'x' ELSE '' END || CAST(o_orderkey AS VARCHAR(20))
               || CASE o_orderkey % 3 WHEN 0 THEN '_original' WHEN 1 THEN '_preview' ELSE '' END || CASE o_orderkey % 11 WHEN 0 THEN '.tmp' ELSE '.pdf' END AS path,
               o_orderkey * 7 AS length, o_orderdate AS modified_at
        FROM {orders}
    """,
    # Findings of two revisions: events before and after the middle of the month.
    "plant_findings": """
        SELECT id, job_id, pair, side, category, severity, page_number, "offset", length, rule_id, token,
               CASE WHEN category = 'kbbi' THEN 'Kata "' || coalesce(token, 'Sistim') || '" tidak ditemukan di basis data lokal.' ELSE 'Periksa penulisan.' END AS message,
               CASE WHEN id % 4 = 1 THEN NULL WHEN id % 4 = 2 THEN ' ' ELSE 'usul' || CAST(k AS VARCHAR(5)) END AS suggestion,
               CASE WHEN id % 19 = 0 THEN NULL ELSE 'di  dalam ' || coalesce(token, '(panjang)') || ' kalimat nomor ' || CAST(k AS VARCHAR(5)) END AS excerpt,
               resolved_at, created_at
        FROM (SELECT event_id AS id, 'E' || CAST(user_id % 50 AS VARCHAR(5)) AS job_id, 'P' || CAST(user_id % 4 AS VARCHAR(5)) AS pair,
                     CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'before' ELSE 'after' END AS side,
                     CASE WHEN event_type IN ('click', 'view') THEN 'kbbi' ELSE 'eyd' END AS category,
                     CASE event_id % 5 WHEN 0 THEN 'error' WHEN 4 THEN 'info' ELSE 'warning' END AS severity,
                     CAST(1 + event_id % 13 AS INT) AS page_number, CAST(event_id * 7 % 600 AS INT) AS "offset", 6 AS length,
                     CASE WHEN event_id % 50 = 7 THEN NULL
                          WHEN event_type IN ('click', 'view') THEN CASE event_id % 2 WHEN 0 THEN 'kbbi.unknown-word' ELSE 'kbbi.unknown-word.database-only' END
                          ELSE CASE event_id % 4 WHEN 0 THEN 'eyd.foreign-not-italic' WHEN 1 THEN 'eyd.double-space' WHEN 2 THEN 'eyd.kemana-one-word' ELSE 'eyd.acronym-undeclared' END END AS rule_id,
                     CASE user_id % 6 WHEN 0 THEN 'Sistim' WHEN 1 THEN 'resiko' WHEN 2 THEN ' ' WHEN 3 THEN NULL WHEN 4 THEN 'Praktek-an' ELSE 'héma(t)' END AS token,
                     (event_id + CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 0 ELSE 3 END) % 40 AS k,
                     CASE WHEN event_id % 6 = 0 THEN ts END AS resolved_at, ts AS created_at
              FROM {events}) x
    """.replace('"offset"', "`offset`"),
    "plant_evals": """
        SELECT 'E' || CAST(c_custkey AS VARCHAR(20)) AS job_id, 'skripsi_' || CAST(c_custkey AS VARCHAR(20)) || '.pdf' AS filename,
               CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'extracting' WHEN 2 THEN 'analyzing' WHEN 3 THEN 'done' ELSE 'failed' END AS status,
               CASE WHEN c_custkey % 9 <> 4 THEN CAST(c_custkey % 70 AS INT) END AS total_pages, CAST(c_custkey % 40 AS INT) AS extracted_pages,
               CAST(c_custkey % 13 * 250 AS INT) AS kbbi_total, CAST(c_custkey % 31 * 120 AS INT) AS kbbi_progress,
               CAST(c_custkey % 8 AS INT) AS eyd_total, CAST(c_custkey % 6 AS INT) AS eyd_progress
        FROM {customer}
    """,
    # Stored results of track jobs: a citation per reference, every fourth key occurs twice.
    "t_citations": """
        SELECT job_id, reference_id * 2 AS citation_id, author || ', ' || year AS citation_key, CAST(1 + reference_id % 30 AS INT) AS thesis_page,
               'Menurut "' || author || '", hal ' || title AS thesis_context FROM {plant_refs}
        UNION ALL
        SELECT job_id, reference_id * 2 + 1, author || ', ' || year, CAST(1 + reference_id % 23 AS INT), 'Lagi' || chr(10) || title FROM {plant_refs} WHERE reference_id % 4 = 1
    """,
    "t_matches": """
        SELECT job_id, citation_key, CASE WHEN reference_id % 6 = 5 THEN NULL ELSE reference_id END AS reference_id,
               CASE reference_id % 6 WHEN 5 THEN 'unmatched' WHEN 4 THEN 'fuzzy' ELSE 'exact' END AS match_type,
               CASE reference_id % 6 WHEN 5 THEN 0.0E0 WHEN 4 THEN 0.85E0 ELSE 1.0E0 END AS confidence
        FROM (SELECT job_id, author || ', ' || year AS citation_key, min(reference_id) AS reference_id FROM {plant_refs} GROUP BY job_id, author || ', ' || year) x
        WHERE reference_id % 13 <> 12
    """,
    "t_passages": """
        SELECT job_id, citation_id * 3 AS passage_id, citation_id, CAST(citation_id % 40 AS INT) AS source_page, 'Bagian ' || thesis_context AS matched_passage,
               CAST(citation_id % 101 AS DOUBLE) / 100 AS confidence, CASE citation_id % 2 WHEN 0 THEN 'Shared entity overlap' ELSE 'High Levenshtein similarity' END AS reasoning
        FROM {t_citations} WHERE citation_id % 3 <> 1
    """,
    # Text runs: a line item per run, placed one after the other with small gaps.
    "plant_runs": """
        SELECT job_id, page_number, place * 24 + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS start, place * 24 + 18 + k % 6 AS `end`,
               CASE k % 8 WHEN 0 THEN 'F-Italic' WHEN 1 THEN 'F-Mono' WHEN 2 THEN 'F-Other' ELSE 'F-Body' END AS font_name,
               CASE k % 10 WHEN 0 THEN 14.0E0 WHEN 1 THEN 10.2E0 ELSE 10.0E0 END AS size, k % 8 = 1 AS is_mono, k % 8 = 0 OR k % 7 = 3 AS name_is_italic
        FROM (SELECT 'L' || CAST(l_suppkey AS VARCHAR(20)) AS job_id, CAST(l_partkey % 50 AS INT) AS page_number, l_orderkey * 7 + l_linenumber + l_partkey AS k,
                     row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place
              FROM {lineitem}) x
    """,
    "conversations_text": """
        SELECT conv_id * 1000 + turn AS doc_id, text FROM {conversations}
    """,
    # Title pages with none, one or several masthead signals.
    "plant_front": f"""
        SELECT page_id, CASE page_id % 6
            WHEN 0 THEN 'Jurnal Contoh Vol. 4 No. 2 ISSN 1234-5678' || {NL} || 'A B S T R A K isi' || {NL}
                 || 'P E N D A H U L U A N ' || body
            WHEN 1 THEN 'Volume 12 tanpa sinyal lain. INTRODUCTION ' || body
            WHEN 2 THEN 'E-ISSN 2345, surel: a.b@contoh.ac.id. Introduction' || body
            WHEN 3 THEN 'DOI: 10.1000/x ISBN 978. Latar   Belakang terlalu pendek'
            WHEN 4 THEN 'DOI 10.1/y dan Nomor 7, tanpa pembuka. ' || body
            ELSE body END AS content
        FROM (SELECT page_id, 'Isi halaman ' || url || ' yang cukup panjang untuk dinilai oleh pencocok kutipan sebagai badan teks.' AS body
              FROM {{pages}}) x
    """,
}


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# Views that feed per-character work.
TEXT_VIEWS = {"plant_pages", "plant_text"}


def _needs(sql: str) -> list[str]:
    """Tables and views named in braces (other braces belong to patterns)."""
    found = dict.fromkeys(re.findall(r"\{(\w+)\}", sql))
    return [n for n in found if n in VIEWS or n in TABLES]


def table(spark: SparkSession, sf_dir: str, table_name: str) -> DataFrame:
    """A given table; its timestamps are UTC, so they are read as instants."""
    path = f"{sf_dir}/{table_name}.parquet"
    df = spark.read.parquet(path)
    if any(isinstance(f.dataType, TimestampNTZType) for f in df.schema.fields):
        fields = [
            StructField(f.name, TimestampType() if isinstance(f.dataType, TimestampNTZType) else f.dataType)
            for f in df.schema.fields
        ]
        df = spark.read.schema(StructType(fields)).parquet(path)
    return spread(df) if table_name == "documents" else df


def spread(df: DataFrame) -> DataFrame:
    """Deal out text rows over ``spark.naskah.scan.partitions`` tasks, if a launcher set it.

    For files with fewer row groups than cores; unset (the default) leaves scans as they are.
    """
    n = df.sparkSession.conf.get("spark.naskah.scan.partitions", None)
    return df.repartition(int(n)) if n else df


def view(spark: SparkSession, sf_dir: str, view_name: str, **given: DataFrame) -> DataFrame:
    """A derived view, or a given table when there is no view of that name.

    ``given`` holds views that the caller has already made, for several others on top of one.
    """
    if view_name in given:
        return given[view_name]
    if view_name not in VIEWS:
        return table(spark, sf_dir, view_name)
    sql = re.sub(r"@words\((\w+)\)@", r"explode(regexp_extract_all(lower(\1), '[a-z]+', 0))", VIEWS[view_name])
    df = spark.sql(sql, **{n: view(spark, sf_dir, n, **given) for n in _needs(sql)})
    return spread(df) if view_name in TEXT_VIEWS else df


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, with the views it names as common table expressions."""
    ctes: dict[str, str] = {}

    def add(view_name: str) -> None:
        if view_name in VIEWS and view_name not in ctes:
            for n in _needs(VIEWS[view_name]):
                add(n)
            ctes[view_name] = re.sub(
                r"@words\((\w+)\)@", r"unnest(regexp_extract_all(lower(\1), '[a-z]+'))", VIEWS[view_name].replace('`', '"')
            )

    for n in _needs(sql):
        add(n)
    body = sql.strip()
    if ctes:
        head = ",\n".join(f"{n} AS MATERIALIZED ({q.strip()})" for n, q in ctes.items())
        rest = re.sub(r"^WITH( RECURSIVE)?", "", body)
        body = f"WITH RECURSIVE {head},\n{rest}" if body.startswith("WITH") else f"WITH {head}\n{body}"
    return re.sub(r"\{(%s)\}" % "|".join([*VIEWS, *TABLES]), r"\1", body)
