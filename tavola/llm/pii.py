"""Personal data (operator 5, DataFrame functions only): base patterns, then
bootstrapped contextual extraction.

Base: four kinds by regular expression and check (``KINDS``), leftmost and
without overlap per kind; positions are code points.  The expressions are
anchored at run starts or the previous match and possessive, so they take
linear time and no recursion on long texts, with the same matches as the plain
forms.

Bootstrapping: base entities are seeds.  Identifier-like strings that are no
seed are unseen instances.  The words around an occurrence are its lexical
patterns; in the graph of patterns and distinct instances, a pattern's
confidence in a kind is the share of its instances that are of the kind, an
instance's score is a noisy-or over its patterns, and both are computed in
turn for some rounds.  Occurrences of unseen instances in a pattern of high
confidence and support become further spans if their form suits the kind.
Copies of a text count once, as the graph has distinct edges.

Cases: a null text is empty; a row is known by doc_id (null included) and a
hash of its text, so repeated rows have the same spans; other columns pass
through ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: kind: what a text must hold, the matches (group 0), what a match must pass
_PATTERN = {
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9]++(?:[\x20-][0-9]++)*+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Loose forms of unseen identifiers.
_NUMBER = r"[0-9]++(?:[().\x20/-]{1,3}+[0-9]++)*+"
_MAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]++)*+"
WINDOW = 48
_SPANS = "array<struct<start:bigint,end:bigint,hit:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    d = F.reverse(_digits(hit))
    doubled = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 1, d.substr(i, F.lit(1)).cast("int")).otherwise(
        (d.substr(i, F.lit(1)).cast("int") * 2) - F.when(d.substr(i, F.lit(1)).cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(13, 19), _luhn(hit)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, needs: str | None, pattern: str, valid) -> Column:
    """Spans of the matches that are valid: the text between the matches gives
    their positions."""
    empty = F.array().cast(_SPANS)
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("h"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.coalesce(F.char_length(x["h"]), F.lit(0))
        one = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["h"].alias("hit"))
        keep = x["h"].isNotNull() & valid(x["h"])
        return F.struct(end.cast("bigint").alias("at"), F.when(keep, F.concat(acc["out"], F.array(one).cast(_SPANS))).otherwise(acc["out"]).alias("out"))

    got = F.aggregate(pieces, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(needs) if needs else F.lit(True), got).otherwise(empty)


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind, an array of (start, end, hit)."""
    return {k: _spans(text, needs, pattern, lambda h, k=k: _valid(k, h)) for k, (needs, pattern) in _PATTERN.items()}


def _around(text: Column, span: Column) -> list[Column]:
    """The two words before and the word after a span, lower-case."""
    before = F.split(F.trim(F.lower(F.regexp_replace(F.substring(text, F.greatest(span["start"] - WINDOW + 1, F.lit(1)).cast("int"),
                                                                 F.least(span["start"], F.lit(WINDOW)).cast("int")), r"\s+", " "))), " ")
    after = F.split(F.trim(F.lower(F.regexp_replace(F.substring(text, (span["end"] + 1).cast("int"), F.lit(WINDOW)), r"\s+", " "))), " ")
    return [F.coalesce(F.try_element_at(before, F.lit(-2)), F.lit("")), F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("")),
            F.coalesce(F.try_element_at(after, F.lit(1)), F.lit(""))]


def _occurrences(text: Column, spans: dict[str, Column]) -> Column:
    """Seeds and unseen identifier-like strings with the words around them."""
    def described(arr: Column, kind: Column) -> Column:
        return F.transform(arr, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), kind.alias("kind"),
                                                   *[c.alias(n) for c, n in zip(_around(text, s), ("l2", "l1", "r1"))]))

    seeds = [described(spans[k], F.lit(k)) for k in KINDS]
    taken = F.concat(*spans.values())
    loose = F.concat(_spans(text, r"[0-9](?:[^0-9A-Za-z]{0,3}[0-9]){6}", _NUMBER, lambda h: F.length(_digits(h)).between(7, 19)),
                     _spans(text, r"@|[\[({]at[\])}]", _MAIL, lambda h: F.lit(True)))
    unseen = F.filter(loose, lambda s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    return F.concat(*seeds, described(unseen, F.lit(None).cast("string")))


def _suits(kind: Column, hit: Column) -> Column:
    n = F.length(_digits(hit))
    mail = hit.rlike(r"@|[\[({]at[\])}]")
    quads = hit.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    return (F.when(kind == "email", mail).when(kind == "ip", quads).when(kind == "card", ~mail & ~quads & n.between(12, 19))
            .otherwise(~mail & ~quads & n.between(7, 15)))


def bootstrap(occurrences: DataFrame, rounds: int = 3, confidence: float = 0.7, support: int = 3, alone: int = 12) -> DataFrame:
    """Of occurrences(doc_id, text_hash, start, end, hit, kind, l2, l1, r1): the
    unseen ones that a trusted pattern finds, with their kind.  A pattern needs
    ``support`` known identifiers; a single word, which may stand before them by
    chance, needs ``alone``."""
    needed = F.when(F.col("pattern").startswith("a "), F.lit(alone)).otherwise(F.lit(support))
    patterns = F.array(F.when(F.col("l2") != "", F.concat(F.lit("b "), "l2", F.lit(" "), "l1")),
                       F.when((F.col("l1") != "") & (F.col("r1") != ""), F.concat(F.lit("m "), "l1", F.lit(" _ "), "r1")),
                       F.when(F.col("l1") != "", F.concat(F.lit("a "), "l1")))
    placed = occurrences.withColumn("pattern", F.explode(F.filter(patterns, lambda p: p.isNotNull())))
    edges = written(placed.select("pattern", "hit").distinct(), "pii-edges")
    width = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = occurrences.where("kind is not null").select("hit", "kind", F.lit(1.0).alias("score")).distinct()
    scores, trusted = seeds, None
    for i in range(rounds):
        trusted = written(edges.join(scores, "hit").groupBy("pattern", "kind")
                          .agg(F.sum("score").alias("s"), F.sum((F.col("score") >= 0.5).cast("int")).alias("k"))
                          .join(width, "pattern").withColumn("confidence", F.least(F.col("s") / (F.col("n") + 1), F.lit(0.999)))
                          .where(F.col("k") >= needed).select("pattern", "kind", "confidence"), "pii-patterns")
        if i + 1 < rounds:
            found = (edges.join(trusted, "pattern").join(seeds.select("hit").distinct(), "hit", "left_anti")
                     .groupBy("hit", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
                     .where(_suits(F.col("kind"), F.col("hit"))))
            scores = seeds.union(found)
    return (placed.where("kind is null").drop("kind").join(trusted.where(F.col("confidence") >= confidence), "pattern")
            .where(_suits(F.col("kind"), F.col("hit")))
            .groupBy("doc_id", "text_hash", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind")))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def find(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text_hash, one array of spans per base kind, added) of every row of
    docs(doc_id, text); ``added`` holds (kind, start, end)."""
    rows = docs.select("doc_id", F.xxhash64(_text()).alias("text_hash"), _text().alias("text"))
    rows = rows.withColumns(base_spans(F.col("text")))
    rows = rows.withColumn("seen", _occurrences(F.col("text"), {k: F.col(k) for k in KINDS})).drop("text")
    rows = written(rows, "pii-spans")
    added = _grouped(bootstrap(rows.select("doc_id", "text_hash", F.explode("seen").alias("o")).select("doc_id", "text_hash", "o.*"), **how))
    return _attach(rows.drop("seen"), added)


def _grouped(added: DataFrame) -> DataFrame:
    one = F.struct("kind", "start", "end")
    return added.groupBy("doc_id", "text_hash").agg(F.collect_list(one).alias("added"))  # one text's spans


def _attach(rows: DataFrame, added: DataFrame) -> DataFrame:
    a = added.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "added")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return (rows.join(a, rows["doc_id"].eqNullSafe(a["_d"]) & (rows["text_hash"] == a["_h"]), "left").drop("_d", "_h")
            .withColumn("added", F.coalesce("added", none)))


def listed(kinds: dict[str, Column]) -> Column:
    """kind:start:end of all spans by kind, then start, joined by commas."""
    def shown(kind: str, arr: Column) -> Column:
        return F.transform(arr, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    parts = [shown(k, arr) for k, arr in kinds.items()]
    return F.array_join(F.concat(*parts), ",")


def all_spans() -> dict[str, Column]:
    """Per kind, base and added spans by start."""
    def merged(kind: str) -> Column:
        base = F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        more = F.transform(F.filter("added", lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.array_sort(F.concat(base, more))
    return {k: merged(k) for k in KINDS}


def redact(docs: DataFrame, **how) -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in angle brackets;
    overlapping spans are replaced together under the first one's kind."""
    columns = docs.columns
    found = find(docs, **how)

    def named(kind: str, arr: Column) -> Column:
        return F.transform(arr, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    spans = F.concat(*[named(k, arr) for k, arr in all_spans().items()])
    marks = written(found.withColumn("spans", F.array_sort(spans)).where(F.size("spans") > 0).select("doc_id", "text_hash", "spans").distinct(), "pii-marks")
    m = marks.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("spans").alias("_spans"))
    text = _text()
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.concat(acc["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    joined = docs.withColumn("_k", F.xxhash64(text)).alias("d").join(m, F.col("d.doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h")), "left")
    return joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(done)).select(*[f"`{c}`" for c in columns])
