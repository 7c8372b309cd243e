"""Personal data and the terms that give it away (operator 2).

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Each distinct
value is a protected entity. Every word of a document with an entity meets that entity, however far
apart they stand. Over the whole corpus, the pointwise mutual information of term and entity, as a
share of the entity's own information content, is the term's disclosure, 1 where knowing the term is
knowing the entity. A term at the threshold or above is generalised to its word stem class (``abc*``)
where that class discloses less, and removed otherwise, wherever it occurs, also in documents
without the entity. Estimates need a minimum of documents in which term and entity meet, since a
word seen once discloses everything it stands beside. Copies are no evidence: equal texts count as one document, and so do
texts with entities that have the same entities and the same words, such as mails of one wording that differ in a number.

The first scan lists the words of documents with entities only. A term in t of N documents that meets
an entity of e documents in j of them reaches the threshold only if j / t >= (e / N)^(1 - threshold), and the
documents with entities bound t from below, so common words fall out before they are paired. The second scan finds
what is left in all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, materialise, rows, salted, slices, small, table, text_key

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")
STEM = 3

Span = tuple[str, int, int]
_MENTION = "struct<kind:string,start:long,end:long,entity:string>"
_SPAN = "struct<start:long,end:long>"
SCAN_DDL = f"doc_id long, text_key long, mentions array<{_MENTION}>, terms array<string>"
FOUND_DDL = f"doc_id long, text_key long, term string, n double, at array<{_SPAN}>"
_L, _S = pa.int64(), pa.string()
SCAN = pa.schema([
    ("doc_id", _L), ("text_key", _L),
    ("mentions", pa.list_(pa.struct([("kind", _S), ("start", _L), ("end", _L), ("entity", _S)]))),
    ("terms", pa.list_(_S)),
])
FOUND = pa.schema([("doc_id", _L), ("text_key", _L), ("term", _S), ("n", pa.float64()), ("at", pa.list_(pa.struct([("start", _L), ("end", _L)])))])


def emails(text: str) -> Iterator[Span]:
    """Leftmost, non-overlapping. Every match holds one @, so the run of local characters before each @ is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield "email", start, free
        else:
            free = at + 1
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    doubled = [int(d) for d in reversed(digits)]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(doubled)) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind in the order of KINDS, then by start."""
    out = list(emails(text)) if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _digits(value)}"


def _edges(spans: list[Span]) -> list[int]:
    """Starts and ends, in turn, of what the spans cover together."""
    out: list[int] = []
    for start, end in sorted(s[1:] for s in spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def words(text: str, edges: list[int]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of the words of two letters and more, in lower case, without those that touch a span. Long texts are read in slices."""
    at = 0
    for part in slices(text):
        for m in _TERM.finditer(part):
            a, b = at + m.start(), at + m.end()
            # Inside a span or over one, if an odd number of edges lie before either end, or any between.
            if b - a > 1 and (not edges or (k := bisect_right(edges, a)) % 2 == 0 and bisect_left(edges, b) == k):
                yield m[0].lower(), a, b
        at += len(part)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, mentions and, of texts with mentions, the distinct words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in rows(batches):
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                spans = base_spans(text or "")
                mentions = [{"kind": k, "start": a, "end": b, "entity": _entity(k, text[a:b])} for k, a, b in spans]
                yield doc_id, key, mentions, sorted({w for w, *_ in words(text, _edges(spans))}) if spans else []

    return map_rows(docs.select(docs["doc_id"].cast("long"), text_key(docs["text"]), docs["text"].cast("string")), run, SCAN_DDL, SCAN)


def _stem(term):
    return F.concat(F.substring(term, 1, STEM), F.lit("*"))


def observed() -> Column:
    """What tells apart the observations in ``scan``: entities and words of a text with entities, any other text itself."""
    held = F.xxhash64(F.lit("held"), F.array_sort(F.array_distinct("mentions.entity")), "terms")
    return F.when(F.size("mentions") > 0, held).otherwise(F.col("text_key"))


def repeated_texts(scanned: DataFrame) -> DataFrame:
    """(text_key, least_id, share) of texts in several rows or observed in another text, written: rows of ``least_id`` count as ``share`` of a document each, others as none."""
    named = scanned.groupBy("text_key", observed().alias("observed"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "n")).alias("least")
    texts = materialise(named.groupBy("text_key", "observed").agg(least, F.count(F.lit(1)).alias("names")))
    firsts = texts.groupBy("observed").agg(F.min("text_key").alias("first"), F.count(F.lit(1)).alias("texts")).where("texts > 1").select("observed", "first")
    later = materialise(salted(texts, firsts, "observed", "text_key").where("text_key != first").select("text_key"))
    shared = texts.where("names > 1 OR least.n > 1").join(later, "text_key", "left_anti").select("text_key", F.col("least.doc_id").alias("least_id"), (F.lit(1.0) / F.col("least.n")).alias("share"))
    return materialise(shared.unionByName(later.select("text_key", F.lit(None).cast("long").alias("least_id"), F.lit(0.0).alias("share"))))


def occurrences(docs: DataFrame, terms: DataFrame, most: int = 1_000_000, repeated: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, term, n, at) of each row and word of ``terms``; and of the stem classes of ``terms`` in how many documents they occur, as (term, n) alone.

    ``n`` sums up to documents, where each row is one but for those of ``repeated`` (see ``repeated_texts``).
    ``terms`` (written, distinct) goes to the tasks as a set if it has ``most`` rows at most; otherwise every word is listed and joined.
    """
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs["text"]).alias("text_key"), docs["text"].cast("string").alias("text"))
    if repeated is None:
        keyed = keyed.withColumn("weight", F.lit(1.0))
    else:
        weight = F.when(F.col("share").isNull(), 1.0).when(F.col("doc_id").eqNullSafe(F.col("least_id")), F.col("share")).otherwise(0.0)
        keyed = keyed.join(small(repeated), "text_key", "left").select("doc_id", "text_key", "text", weight.alias("weight"))
    listed = terms.limit(most + 1).count() <= most
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect()) if listed else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        wanted, classes = shared.value, defaultdict(float)
        stems = None if wanted is None else {t[:STEM] for t in wanted}
        for batch in rows(batches):
            for doc_id, key, text, weight in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                found = {w for part in slices(text) for w in _TERM.findall(part.lower())}
                if stems is not None and not any(w[:STEM] in stems for w in found):
                    continue
                spans = base_spans(text)
                if wanted is None or spans or not wanted.isdisjoint(found):
                    at: dict[str, list] = defaultdict(list)
                    for w, a, b in words(text, _edges(spans)):
                        at[w].append({"start": a, "end": b})
                    found = set(at)
                    for w in at if wanted is None else wanted.intersection(at):
                        yield doc_id, key, w, weight, at[w]
                else:
                    found = {w for w in found if len(w) > 1}
                for stem in {w[:STEM] for w in found if stems is None or w[:STEM] in stems} if weight else ():
                    classes[stem] += weight
            if len(classes) > most:
                yield from ((None, None, c + "*", n, None) for c, n in classes.items())
                classes.clear()
        yield from ((None, None, c + "*", n, None) for c, n in classes.items())

    found = map_rows(keyed, run, FOUND_DDL, FOUND)
    if listed:
        return found
    either = terms.unionByName(terms.select(_stem("term").alias("term"))).distinct()
    return found.join(either, "term", "left_semi")


def joint_terms(scanned: DataFrame, threshold: float, support: int) -> DataFrame:
    """(entity, n_entity, term, n_joint) of pairs that meet in ``support`` rows and may reach the threshold, and of the stem classes of their terms."""
    total = float(max(1, scanned.count()))
    holding = scanned.where(F.size("mentions") > 0).select(F.array_distinct("mentions.entity").alias("entities"), "terms")
    entities = materialise(holding.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support))
    largest = entities.agg(F.max("n_entity")).first()[0] or 0
    most = lambda e: e * F.pow(F.lit(total) / e, F.lit(1 - threshold)) + F.lit(1e-9)
    # Words in more rows than the most frequent entity allows drop out here, so no common word is a hot key below.
    seen = holding.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_seen"))
    seen = materialise(seen.where((F.col("n_seen") >= support) & (F.col("n_seen") <= most(F.lit(float(max(1, largest)))))))
    by_entity = holding.select(F.explode("entities").alias("entity"), "terms").join(small(entities), "entity")
    pairs = by_entity.select("entity", "n_entity", F.explode("terms").alias("term")).join(small(seen), "term").where(F.col("n_seen") <= most(F.col("n_entity")))
    joint = materialise(pairs.groupBy("entity", "n_entity", "term").agg(F.count(F.lit(1)).alias("n_joint")).where(F.col("n_joint") >= support))
    of_class = joint.select("entity", _stem("term").alias("term")).distinct()
    classes = by_entity.select("entity", "n_entity", F.explode(F.array_distinct(F.transform("terms", _stem))).alias("term")).join(of_class, ["entity", "term"])
    return materialise(joint.unionByName(classes.groupBy("entity", "n_entity", "term").agg(F.count(F.lit(1)).alias("n_joint"))))


def disclosing_terms(scanned: DataFrame, joint: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(entity, term, disclosure, action): terms whose disclosure of an entity is ``threshold`` or more. An entity in every row has no information and is disclosed by nothing."""
    total = F.lit(float(max(1, scanned.count())))
    counted = joint.join(found.groupBy("term").agg(F.round(F.sum("n")).alias("n")).where("n > 0"), "term")
    ic = F.log(total / F.col("n_entity"))
    pmi = F.log(total * F.col("n_joint") / (F.col("n_entity") * F.col("n")))
    shown = materialise(counted.select("entity", "term", F.when(ic > 0, pmi / F.when(ic > 0, ic)).otherwise(0.0).alias("disclosure")))
    by_class = shown.where(F.col("term").endswith("*")).select("entity", F.col("term").alias("stem"), F.col("disclosure").alias("class_disclosure"))
    terms = shown.where(~F.col("term").endswith("*") & (F.col("disclosure") >= threshold)).withColumn("stem", _stem("term"))
    safe = F.coalesce(F.col("class_disclosure") < threshold, F.lit(False))
    return terms.join(by_class, ["entity", "stem"], "left").select("entity", "term", "disclosure", F.when(safe, "generalise").otherwise("remove").alias("action"))


def private_terms(docs: DataFrame, scanned: DataFrame, threshold: float, support: int) -> DataFrame:
    """(doc_id, text_key, terms): the spans and actions of the disclosing terms of each text that has any, written."""
    evidence = materialise(scanned.select(observed().alias("observed"), "mentions", "terms").dropDuplicates(["observed"]))
    joint = joint_terms(evidence, threshold, support)
    terms = materialise(joint.where(~F.col("term").endswith("*")).select("term").distinct())
    found = materialise(occurrences(docs, terms, repeated=repeated_texts(scanned)))
    actions = materialise(disclosing_terms(evidence, joint, found, threshold).groupBy("term").agg(F.max("action").alias("action")))  # remove wins over generalise
    at = found.where(F.col("at").isNotNull()).join(small(actions), "term").select("doc_id", "text_key", "action", F.explode("at").alias("x"))
    spans = F.array_sort(F.collect_set(F.struct("x.start", "x.end", "action")))  # rows that repeat doc_id and text have one answer
    return materialise(at.groupBy("doc_id", "text_key").agg(spans.alias("terms")))


_NO_TERMS = "array<struct<start:long,end:long,action:string>>"


def with_terms(left: DataFrame, terms: DataFrame) -> DataFrame:
    """``left`` (doc_id, text_key, ...) with its terms, an empty array where there are none."""
    named = small(terms.withColumnsRenamed({"doc_id": "__of_id", "text_key": "__of_text"}))
    same = left["doc_id"].eqNullSafe(F.col("__of_id")) & left["text_key"].eqNullSafe(F.col("__of_text"))
    return left.join(named, same, "left").drop("__of_id", "__of_text").withColumn("terms", F.coalesce("terms", F.array().cast(_NO_TERMS)))


def find_private(docs: DataFrame, threshold: float = 0.9, support: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, mentions, terms (start, end, action).

    A null text counts as empty and has no spans. Repeated rows and copies get one answer and count as one document where terms are judged. Very long
    texts are read in slices. An empty table gives no rows; other columns are ignored.
    """
    scanned = materialise(scan(docs))
    return with_terms(scanned.drop("terms"), private_terms(docs, scanned, threshold, support)).select("doc_id", "mentions", "terms")


def sanitise(docs: DataFrame, threshold: float = 0.9, support: int = 3) -> DataFrame:
    """doc_id and text, base spans replaced by their kind in brackets, terms generalised or removed.

    A null text stays null. Each row gets the answer of its own doc_id and text, nulls and repeated ids included. An
    empty table gives no rows; other columns are ignored.
    """
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs["text"]).alias("text_key"), docs["text"].cast("string").alias("text"))
    terms = private_terms(keyed, materialise(scan(keyed)), threshold, support)
    ddl, schema = "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in rows(batches):
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                yield doc_id, None if text is None else rewritten(text, base_spans(text), [(t["start"], t["end"], t["action"]) for t in found])

    return map_rows(with_terms(keyed, terms).select("doc_id", "text", "terms"), run, ddl, schema)


def rewritten(text: str, spans: list[Span], terms: list[tuple[int, int, str]]) -> str:
    """Overlapping spans are replaced by the first of them in text order, the longer of two that start together."""
    changes = [(a, -b, f"[{kind}]") for kind, a, b in spans] + [(a, -b, text[a : a + STEM] + "*" if act == "generalise" else "") for a, b, act in terms]
    out, at = [], 0
    for a, minus_b, new in sorted(changes):
        if a >= at:
            out += [text[at:a], new]
            at = -minus_b
        else:
            at = max(at, -minus_b)
    return "".join(out) + text[at:]


def _is(kind: str):
    return lambda m: m["kind"] == F.lit(kind)


def _joined(spans) -> F.Column:
    return F.array_join(spans, ",")


def op2_information_theoretic_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, counts of the base kinds, their digest, all spans, n_term; see ``find_private``."""
    found = find_private(table(spark, sf_dir, "documents"))
    span = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("mentions", lambda m: span(m["kind"], m))
    terms = F.transform("terms", lambda t: span(F.lit("term"), t))
    counts = [F.size(F.filter("mentions", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, terms)).alias("spans"), F.size("terms").cast("long").alias("n_term"))
