"""Applying and re-anchoring fixes, locating excerpts, resolving findings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from naskah.functions import passages as P
from naskah.functions import text as T
from naskah.operators.rule_scan import python_regex

# Reasons why a fix is not applied.
INCOMPLETE = "data perbaikan tidak lengkap"
CHANGED = "teks sumber sudah berubah"
NO_PAGE = "halaman tidak diketahui"
NOT_FOUND = "tidak ditemukan di dokumen"
OVERLAP = "tumpang tindih dengan perbaikan lain"
ITALIC_BY_HAND = "jadikan miring sendiri di dokumenmu"


def set_resolved(findings: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Findings with ``resolved_at`` set (or cleared with a null) for the given ids."""
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return findings.join(marked, "id", "left").withColumn(
        "resolved_at", F.when(F.col("_hit"), at).otherwise(F.col("resolved_at"))
    ).drop("_hit")


_RANGES = "array<struct<start:int,end:int>>"
_LOG = "array<struct<finding_id:bigint,reason:string>>"


def _kinds(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{x} {df.schema[x].dataType.simpleString()}" for x in names)


def _lists(column: pa.Array) -> tuple[list[int], list[list]]:
    """Bounds of each row's list of structs, and the fields of all its members as plain lists."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return [0, *np.cumsum(sizes).tolist()], [pc.struct_field(flat, k).to_pylist() for k in range(flat.type.num_fields)]


def fold_fixes(text: str | None, fixes: Iterable[tuple]) -> tuple[str | None, list[tuple[int, int]], list[tuple]]:
    """(text, italic ranges, log) after the fixes ``(finding_id, offset, length, token, suggestion, is_italic)``."""
    italic: list[tuple[int, int]] = []
    log = []
    for finding, start, length, token, suggestion, slanted in fixes:
        reason = None
        if start is None or length is None or not token:
            reason = INCOMPLETE
        else:
            end = start + length
            if text is not None and text[max(start, 0) : max(end, 0)] != token:
                reason = CHANGED
            elif slanted is False and not suggestion:
                reason = INCOMPLETE
            elif slanted is False:
                delta = len(suggestion) - length
                italic = [(s + delta, e + delta) if s >= end else (s, e) for s, e in italic]
                text = None if text is None else text[: max(start, 0)] + suggestion + text[end:]
            elif slanted:
                italic.append((start, end))
        log.append((finding, reason))
    return text, sorted(italic), log


def apply_fixes(pages: DataFrame, fixes: DataFrame) -> DataFrame:
    """Page texts with their fixes applied, right to left.

    Fixes: ``job_id, page_number, finding_id, offset, length, token, suggestion, is_italic``.
    Adds ``new_content``, ``italic_ranges`` (moved by edits before them) and ``log`` of
    ``finding_id, reason`` (null when applied). A page's own fixes are folded in its row; a page without fixes stays as it is.
    """
    per_page = fixes.groupBy("job_id", "page_number").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (-F.coalesce("offset", F.lit(0))).alias("order"), F.col("finding_id").cast("bigint").alias("finding_id"),
                    "offset", "length", "token", "suggestion", "is_italic",
                )
            )
        ).alias("edits")
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        entries = pa.list_(pa.struct([("finding_id", pa.int64()), ("reason", pa.string())]))
        for batch in batches:
            bounds, (_, *fields) = _lists(batch.column(3))
            edits = list(zip(*fields))
            done = [fold_fixes(t, edits[a:b]) for t, a, b in zip(batch.column(2).to_pylist(), bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array([d[0] for d in done], pa.string()),
                    _listed([d[1] for d in done], ranges), _listed([d[2] for d in done], entries),
                ],
                names=["job_id", "page_number", "content", "new_content", "italic_ranges", "log"],
            )

    joined = pages.join(per_page, ["job_id", "page_number"], "left").select("job_id", "page_number", "content", "edits")
    return joined.mapInArrow(
        fold, f"{_kinds(pages, 'job_id', 'page_number')}, content string, new_content string, italic_ranges {_RANGES}, log {_LOG}"
    )


def _listed(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """Lists of pairs as lists of structs."""
    fields = kind.value_type
    flat = [x for row in rows for x in row]
    parts = [pa.array([x[k] for x in flat], fields[k].type) for k in range(fields.num_fields)]
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(fields)))


def change_log(fixes: DataFrame, applied_pages: DataFrame) -> DataFrame:
    """One row per fix: applied or not, with before, after and reason. A fix of an absent page is not applied."""
    log = applied_pages.select("job_id", "page_number", F.explode("log").alias("l")).select(
        "job_id", "page_number", "l.*", F.lit(True).alias("seen")
    )
    rows = fixes.join(log, ["job_id", "page_number", "finding_id"], "left")
    reason = F.when(F.col("page_number").isNull() | F.col("seen").isNull(), NO_PAGE).otherwise(F.col("reason"))
    return rows.select(
        "job_id", "page_number", "finding_id", "category", "rule_id",
        F.when(F.col("is_italic"), "italic").otherwise("replace").alias("kind"),
        F.coalesce("token", F.lit("")).alias("before"),
        F.when(F.col("is_italic"), F.coalesce("token", F.lit(""))).otherwise(F.coalesce("suggestion", F.lit(""))).alias("after"),
        reason.alias("reason"),
        reason.isNull().alias("applied"),
    )


_BLANKS = python_regex(T.WS + "+")


def _squeeze(text: str) -> str:
    return _BLANKS.sub(" ", text).strip(" ")


def _common_start(a: Iterable[str], b: Iterable[str]) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def best_place(text: str, token: str, excerpt: str) -> int | None:
    """Where ``token`` stands in ``text``: the occurrence whose 40 characters on both sides fit the excerpt best."""
    places = []
    at = text.find(token)
    while at >= 0:
        places.append(at)
        at = text.find(token, at + len(token))
    if len(places) < 2:
        return places[0] if places else None
    excerpt, bare = _squeeze(excerpt), _squeeze(token)
    at = excerpt.find(bare)
    if at < 0:
        return places[0]
    left, right = excerpt[:at].strip(" ")[::-1], excerpt[at + len(bare) :].strip(" ")

    def fit(s: int) -> int:
        before, after = _squeeze(text[max(s - 40, 0) : s]), _squeeze(text[s + len(token) : s + len(token) + 40])
        return _common_start(before[::-1], left) + _common_start(after, right)

    return max(places, key=fit)


def place_findings(text: str | None, findings: list[tuple]) -> list[tuple]:
    """``finding_id, start, end, reason`` of the findings ``(finding_id, token, excerpt, suggestion, is_italic)`` of one job."""
    out, placed = [], []
    for finding, token, excerpt, suggestion, slanted in findings:
        start, reason = None, None
        if slanted:
            reason = ITALIC_BY_HAND
        elif not token or not suggestion:
            reason = INCOMPLETE
        else:
            if slanted is False and text is not None:
                start = best_place(text, token, excerpt or "")
            if start is None:
                reason = NOT_FOUND
            else:
                placed.append((start, start + len(token), finding, len(out)))
        out.append([finding, start, None if start is None else start + len(token), reason])
    last = -1
    for start, end, _, i in sorted(placed):
        if start >= last:
            last = end
        else:
            out[i][3] = OVERLAP
    return out


def reanchor(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """Places each finding in a revised text of its job (``job_id, text``).

    The best occurrence is the one whose 40 characters on both sides fit the excerpt, the first of
    equal ones; then places are kept left to right while they do not overlap. Returns
    ``finding_id, start, end, reason`` (null when placed). The findings of a job are placed in the row of its text.
    """
    per_job = findings.groupBy("job_id").agg(
        F.collect_list(F.struct("finding_id", "token", "excerpt", "suggestion", "is_italic")).alias("found")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, fields = _lists(batch.column(2))
            rows = list(zip(*fields))
            out, job = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                done = place_findings(text, rows[bounds[i] : bounds[i + 1]])
                out += done
                job += [i] * len(done)
            columns = list(zip(*out)) or [[]] * 4
            kinds = [batch.schema.field(2).type.value_type[0].type, pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(job, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["job_id", "finding_id", "start", "end", "reason"],
            )

    joined = per_job.join(texts, "job_id", "left").select("job_id", "text", "found")
    return joined.mapInArrow(place, f"{_kinds(findings, 'job_id', 'finding_id')}, start int, end int, reason string")


_MARKS = "­​‌‍⁠﻿"


def locate_excerpt(text: Column, query: Column) -> Column:
    """``struct<start,end>`` of an excerpt in a page text, or null.

    Tried in order: the whole excerpt, the excerpt without up to three words on each side
    (8 characters or more), its longest words, then everything without blanks.
    """
    page = P.normalize(F.translate(text, _MARKS, ""))
    wanted = P.normalize(F.translate(query, _MARKS, ""))

    def search(t: Column, q: Column) -> Column:
        words = F.split(q, " ")
        trims = F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit(3)),
                lambda l: F.transform(
                    F.sequence(F.lit(0), F.lit(3)),
                    lambda r: F.when(
                        F.size(words) - l - r > 0,
                        F.array_join(F.slice(words, l + 1, F.greatest(F.size(words) - l - r, F.lit(0))), " "),
                    ),
                ),
            )
        )
        shorter = F.filter(trims, lambda s: (F.length(s) >= 8) & (s != q))
        longest = F.transform(
            F.array_sort(
                F.transform(
                    F.filter(F.split(q, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3),
                    lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")),
                )
            ),
            lambda x: x["w"],
        )
        tries = F.concat(F.array(q), shorter, longest)
        direct = F.get(
            F.filter(
                F.transform(tries, lambda s: F.struct(F.instr(t, s).alias("at"), F.length(s).alias("n"))),
                lambda x: x["at"] > 0,
            ),
            F.lit(0),
        )
        packed = F.replace(t, F.lit(" "), F.lit(""))
        tight = F.filter(
            F.transform(F.concat(F.array(q), longest), lambda s: F.replace(s, F.lit(" "), F.lit(""))),
            lambda s: F.length(s) >= 4,
        )
        squeezed = F.get(
            F.filter(
                F.transform(tight, lambda s: F.struct(F.instr(packed, s).alias("at"), F.length(s).alias("n"))),
                lambda x: x["at"] > 0,
            ),
            F.lit(0),
        )
        # position of the n-th non-blank character in the text with blanks
        solid = F.filter(
            F.transform(F.split(t, ""), lambda ch, i: F.when(ch != " ", i)), lambda i: i.isNotNull()
        )
        return F.when(
            q != "",
            F.coalesce(
                F.when(
                    direct.isNotNull(),
                    F.struct((direct["at"] - 1).alias("start"), (direct["at"] - 1 + direct["n"]).alias("end")),
                ),
                F.when(
                    squeezed.isNotNull(),
                    F.struct(
                        F.get(solid, squeezed["at"] - 1).alias("start"),
                        (F.get(solid, squeezed["at"] + squeezed["n"] - 2) + 1).alias("end"),
                    ),
                ),
            ),
        )

    return T.let(page, lambda t: T.let(wanted, lambda q: search(t, q)))
