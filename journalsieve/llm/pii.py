"""Personal data by bootstrapped contextual extraction.

Strict rules find the seeds: e-mail addresses, IP addresses, payment cards, phone numbers.  The words
around the seeds are patterns; loosely formed identifiers that no rule accepts are candidates.  Patterns
and instances form a graph, scored in rounds: a pattern is as good as the instances it surrounds, an
instance as good as the patterns around it.  Candidates within confident patterns are found as well.

The text is read once; what goes on are the occurrences with their surrounding words, and a pattern or
instance that is very common is summed before it is shuffled.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from journalsieve.llm.common import own_columns
from journalsieve.workspace import settle

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always begins a run of digits, so the search need not begin inside one
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# identifiers that the rules above leave out; the words around them decide
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]{1,64}"
                          r"(?:\x20?(?:\.|[\[({](?:dot|DOT)[\])}])\x20?[A-Za-z0-9-]{1,64})*")
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z+=\"])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")
#: Characters looked at on either side for the surrounding words.
AROUND = 80


@dataclass(frozen=True)
class Bootstrap:
    """Parameters of the scoring: rounds, doubt added to every pattern, least support and confidence."""

    rounds: int = 3
    doubt: float = 1.0
    support: int = 3
    pattern: float = 0.6
    instance: float = 0.5


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points of what the strict rules accept, by kind and start."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((0, start, done))
        at = text.find("@", at + 1)
    for match in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match[0].split(".")):
            found.append((1, *match.span()))
    for match in _CARD.finditer(text):
        digits = _digits(match[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= len(_digits(match[0])) <= 15:
                found.append((3, *match.span()))
    return found


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loosely formed identifiers that overlap no base span."""
    loose = [(1, *m.span()) for m in _LOOSE_IP.finditer(text)] if ":" in text else []
    if "at]" in text or "at)" in text or "at}" in text or "AT" in text:
        loose += [(0, *m.span()) for m in _LOOSE_EMAIL.finditer(text)]
    for match in _LOOSE_NUMBER.finditer(text):
        loose.append((2 if sum("0" <= c <= "9" for c in match[0]) >= 13 else 3, *match.span()))
    if not taken:
        return loose
    spans = sorted((s, e) for _, s, e in taken)
    starts, ends = [s for s, _ in spans], list(itertools.accumulate((e for _, e in spans), max))
    free = []
    for kind, start, end in loose:
        before = bisect.bisect_left(starts, end)  # spans that begin before this one ends
        if not before or ends[before - 1] <= start:
            free.append((kind, start, end))
    return free


def surroundings(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of an occurrence: the words before it, after it, and on both sides."""
    plain = lambda w: re.sub(r"[0-9]+", "9", w.lower().strip(".,;:!?()[]{}<>\"'")) or "-"
    before = [plain(w) for w in text[max(0, start - AROUND):start].split()[-2:]] or ["^"]
    after = [plain(w) for w in text[end:end + AROUND].split()[:1]] or ["$"]
    one, two = f"{before[-1]} _", f"{' '.join(before)} _"
    return list(dict.fromkeys([one, two, f"_ {after[0]}", f"{before[-1]} _ {after[0]}"]))


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SEEN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()),
                   ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, base, seen): base spans, and seeds and candidates with their patterns, of each row.

    ``mark`` is a hash of the text; rows of one id and text are alike in all that follows.
    """
    rows = own_columns(docs, id=id_col, text=text_col).withColumn(
        "text", F.coalesce(F.col("text").cast("string"), F.lit("")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, seen = [], []
            for value in batch.column(1):
                text = value.as_py()
                spans = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                seen.append([
                    {"kind": k, "start": s, "end": e, "seed": seed, "patterns": surroundings(text, s, e),
                     "instance": text[s:e].lower() if k < 2 else _digits(text[s:e])}
                    for seed, group in ((True, spans), (False, candidates(text, spans))) for k, s, e in group])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(base, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))],
                names=["id", "mark", "base", "seen"])

    span = "kind int, start int, end int"
    return rows.select("id", "text", F.xxhash64("text").alias("mark")).mapInArrow(
        scan, f"id {rows.schema['id'].dataType.simpleString()}, mark bigint, base array<struct<"
              f"{span.replace(' ', ':').replace(',:', ',')}>>, seen array<struct<kind:int,start:int,end:int,"
              "seed:boolean,instance:string,patterns:array<string>>>")


def confident_patterns(seen: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """(kind, pattern, confidence) of the patterns to trust, from the graph of patterns and instances."""
    edges = settle(
        seen.select(F.explode("seen").alias("o")).select("o.*")
        .select("kind", "instance", "seed", F.explode("patterns").alias("pattern"))
        .groupBy("kind", "pattern", "instance").agg(
            F.max("seed").alias("seed"), (~F.min("seed")).alias("loose")), "pii-graph")
    instances = edges.groupBy("kind", "instance").agg(F.max("seed").cast("double").alias("trust"))
    patterns = None
    for _ in range(settings.rounds):
        scored = edges.join(instances, ["kind", "instance"])
        patterns = settle(
            scored.groupBy("kind", "pattern").agg(
                (F.sum("trust") / (F.count(F.lit(1)) + settings.doubt)).alias("confidence"),
                F.count(F.when(F.col("seed"), 1)).alias("support")), "pii-patterns")
        # an unseen instance is wrong only if all patterns around it are
        doubt = F.sum(F.log1p(-F.least("confidence", F.lit(0.999999))))
        instances = settle(
            edges.join(patterns.filter(F.col("support") >= settings.support), ["kind", "pattern"], "left")
            .groupBy("kind", "instance").agg(
                F.when(F.max("seed"), 1.0).otherwise(F.coalesce(1 - F.exp(doubt), F.lit(0.0))).alias("trust")),
            "pii-instances")
    trusted = patterns.filter((F.col("support") >= settings.support) & (F.col("confidence") >= settings.pattern))
    # a loose spelling of a known instance counts too, also where the strict one has the same words around it
    found = edges.filter("loose").join(trusted, ["kind", "pattern"]).join(
        instances.filter(F.col("trust") >= settings.instance), ["kind", "instance"])
    return settle(found.select("kind", "pattern", "instance").distinct(), "pii-found")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         settings: Bootstrap = Bootstrap()) -> DataFrame:
    """(id, mark, base, found): base spans and all spans of every row, each by kind and start.

    A null or empty text has no spans.  Rows that share id and text get the same spans; null ids pass
    through; extra columns are left out; an empty table gives an empty table.  Base spans always stay.
    """
    rows = settle(occurrences(docs, id_col, text_col), "pii-occurrences")
    discovered = confident_patterns(rows, settings)
    loose = rows.select("id", "mark", F.explode("seen").alias("o")).select("id", "mark", "o.*").filter("not seed")
    hits = (loose.withColumn("pattern", F.explode("patterns"))
            .join(discovered, ["kind", "pattern", "instance"])
            .groupBy("id", "mark").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
            .select(F.col("id").alias("own"), F.col("mark").alias("own_mark"), "more"))
    joined = rows.join(hits, rows["id"].eqNullSafe(hits["own"]) & (rows["mark"] == hits["own_mark"]), "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return joined.select("id", "mark", "base",
                         F.array_sort(F.concat("base", F.coalesce("more", none))).alias("found"))


def spans_text(column: str):
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars",
           settings: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets; other texts stay as they are.

    Overlapping spans are replaced together, by the kind of the first.  ``n_chars_col`` is brought up to
    date if it is there.  Columns, rows and null texts stay.
    """
    spans = find(docs, id_col, text_col, settings).filter(F.size("found") > 0).select(
        F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("found").alias("__found")).distinct()
    joined = docs.join(spans, docs[id_col].eqNullSafe(F.col("__id"))
                       & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col("__mark")), "left")
    ordered = F.array_sort(F.transform("__found", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(
        F.when(s["start"] < a["at"], a["text"]).otherwise(F.concat(
            a["text"], F.substring(F.col(text_col), a["at"] + 1, s["start"] - a["at"]),
            F.element_at(kinds, s["kind"] + 1))).alias("text"),
        F.greatest(a["at"], s["end"]).alias("at"))
    end = lambda a: F.concat(a["text"], F.substring(
        F.col(text_col), a["at"] + 1, F.char_length(F.col(text_col))))
    text = F.when(F.col("__found").isNull(), F.col(text_col)).otherwise(F.aggregate(ordered, start, step, end))
    result = joined.withColumn(text_col, text)
    if n_chars_col and n_chars_col in docs.columns:
        result = result.withColumn(n_chars_col, F.when(F.col("__found").isNull(), F.col(n_chars_col)).otherwise(
            F.char_length(F.col(text_col)).cast(docs.schema[n_chars_col].dataType)))
    return result.select(*docs.columns)
