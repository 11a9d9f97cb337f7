"""Personal data by patterns, and the terms around it that give it away, with DataFrame functions only.

Base kinds (email, ip, card, phone) are matched by regular expressions and checked. Each valid match is a mention of a
protected entity. The terms of the documents that hold it are weighed by pointwise mutual information over the corpus: a term t discloses
an entity e by PMI(e; t) / IC(e), the share of e's information that seeing t gives away, where
IC(e) = -log2 p(e) and all probabilities are shares of documents. Terms at or above `generalise_at` are generalised, at or
above `remove_at` removed, wherever they stand in a document that holds the entity.

Positions come from splitting a text by a pattern: the lengths of gaps and matches add up, by a running sum over the few
rows that matches make. Only texts that may hold an entity are shuffled, to meet the entities that enough documents hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Possessive forms that match what the plain ones do, without backtracking: a run of address characters or digits that
#: fails at its start fails at each later start in it. \G lets an address begin where the one before ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for its kind to be looked for at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": "\\+[0-9]"}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WORD = r"\p{L}{3,}"


def cut(text: Column, pattern: str, hint: str) -> Column:
    """Array of (m, g): each match of the pattern and the text before it, since the last match. Both passes over the text are made once."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return F.when(text.rlike(hint), found)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: (lambda x: F.when(i % 2 == 1, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x))(F.try_to_number(d, F.lit("9")).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    n = F.length(digits(value))
    card = n.between(12, 19) & luhn(digits(value))
    ip = value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    return F.when(kind == 0, F.lit(True)).when(kind == 1, ip).when(kind == 2, card).otherwise(n.between(9, 15))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Rows under a key that equal rows share (k1, k2), their text, and `more`."""
    i, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(i.alias("doc_id"), F.coalesce(i, F.lit(-1)).alias("k1"), F.xxhash64(i, text).alias("k2"), text.alias("text"), *more)


def base_spans(rows: DataFrame) -> DataFrame:
    """k1, k2, kind (position in KINDS), start, end and entity of each valid match, and times: how many equal rows hold it."""

    def of(kind: int) -> Column:
        name = KINDS[kind]
        pairs = cut(F.col("text"), PATTERNS[name], HINTS[name])
        pairs = F.transform(pairs, lambda z: F.struct(z["m"].alias("m"), F.length(z["g"]).alias("gap")))
        return F.coalesce(F.transform(pairs, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["m"].alias("m"), z["gap"].alias("gap"))), F.array())

    cells = rows.select("k1", "k2", F.explode(F.concat(*[of(k) for k in range(len(KINDS))])).alias("x")).select("k1", "k2", "x.*").groupBy("k1", "k2", "kind", "i", "m", "gap").agg(F.count("*").alias("times"))
    run = Window.partitionBy("k1", "k2", "kind").orderBy("i")
    upto = F.sum(F.col("gap") + F.coalesce(F.length("m"), F.lit(0))).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = cells.withColumn("end", upto).filter("m is not null")
    placed = placed.filter(valid(F.col("kind"), F.col("m")))
    same = F.when(F.col("kind") >= 2, digits(F.col("m"))).otherwise(F.lower("m"))
    return placed.select("k1", "k2", "kind", (F.col("end") - F.length("m")).alias("start"), "end", F.concat_ws(":", F.col("kind").cast("string"), same).alias("entity"), "times")


def terms_of(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def holder_class(*more: Column) -> list[Column]:
    """Aggregates that are equal for equal sets of documents (k1, k2): 128 bits by two sums modulo 2, and `more`."""
    return [F.bit_xor(F.xxhash64(F.lit(seed), "k1", "k2")).alias(f"h{seed}") for seed in (1, 2)] + list(more)


def holders(rows: DataFrame, spans: DataFrame, support: int) -> DataFrame:
    """k1, k2, times, text, words (distinct, taken once) and es of the documents that hold an entity of `support` different
    documents or more, equal rows once. es (e, n_e): the classes of those entities. Entities that the very same documents
    hold are one class: a list that recurs as a whole counts once."""
    pairs = spans.groupBy("k1", "k2", "entity").agg(F.max("times").alias("times"))
    entities = pairs.groupBy("entity").agg(*holder_class(F.count("*").alias("d"), F.sum("times").alias("n_e"))).filter(F.col("d") >= support)
    classed = pairs.join(entities.select("entity", F.struct(F.struct("h1", "h2").alias("e"), "n_e").alias("x")), "entity")
    held = classed.groupBy("k1", "k2").agg(F.max("times").alias("times"), F.collect_set("x").alias("es"))
    hinted = F.col("text").rlike("|".join(f"(?:{x})" for x in HINTS.values()))
    joined = rows.select("k1", "k2", "text").filter(hinted).join(held, ["k1", "k2"])
    texts = joined.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("times").alias("times"), F.first("es").alias("es"))
    return texts.select("k1", "k2", "times", "text", terms_of(F.col("text")).alias("words"), "es")


def term_spans(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """k1, k2, start, kind, end, label of all words of a text that `marks` (k1, k2, term, action) names."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"), F.split("text", WORD, -1).alias("g"))
    cells = F.transform(pairs, lambda z: F.struct(F.lower(z["w"]).alias("term"), F.length(z["g"]).alias("gap"), F.length(z["w"]).alias("len")))
    words = texts.join(marks.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", F.posexplode(cells).alias("i", "x")).select("k1", "k2", "i", "x.*")
    run = Window.partitionBy("k1", "k2").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = words.withColumn("end", F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(run)).filter("len is not null")
    label = F.when(F.col("action") == "remove", "").otherwise("[TERM]").alias("label")
    return ended.join(marks, ["k1", "k2", "term"]).select("k1", "k2", (F.col("end") - F.col("len")).alias("start"), F.lit(len(KINDS)).alias("kind"), "end", label)


def document_frequencies(rows: DataFrame) -> DataFrame:
    """term, n_t: in how many rows each word occurs, over the whole table."""
    return rows.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def disclosures(rows: DataFrame, texts: DataFrame, *, support: int, generalise_at: float, remove_at: float) -> DataFrame:
    """k1, k2, term, action: of each document the terms that give away an entity which it holds. Terms in fewer than
    `support` different documents that hold the entity are left alone: one text says nothing about a pair. All shares are
    those of rows.

    Terms are classed like entities, by the documents of `texts` that hold them, and by how many rows do; pairs are pairs of
    classes. A term in more than n * (n_e / n) ** generalise_at rows can't reach that share, as it shares n_e at most:
    such pairs are never made."""
    total = F.broadcast(rows.agg(F.count("*").alias("n")))  # one row
    words = texts.select("k1", "k2", "times", F.explode("words").alias("term"))
    terms = words.groupBy("term").agg(*holder_class(F.count("*").alias("d"))).filter(F.col("d") >= support)
    terms = terms.join(document_frequencies(rows), "term").select("term", F.struct("h1", "h2", "n_t").alias("t"), "n_t")
    having = words.join(terms, "term").groupBy("k1", "k2", "t", "n_t").agg(F.max("times").alias("times"), F.collect_list("term").alias("terms"))
    having = written(having, "having")
    held = texts.select("k1", "k2", F.explode("es").alias("x")).select("k1", "k2", "x.*")
    most = F.col("n") * F.pow(F.col("n_e") / F.col("n"), F.lit(generalise_at)) * (1 + 1e-9)
    pairs = held.crossJoin(total).withColumn("most", most).join(having.drop("terms"), ["k1", "k2"]).filter(F.col("n_t") <= F.col("most"))
    pairs = pairs.groupBy("e", "t", "n_e", "n_t", "n").agg(F.count("*").alias("d"), F.sum("times").alias("n_et")).filter(F.col("d") >= support)
    content = F.log2(F.col("n") / F.col("n_e"))
    mutual = F.log2(F.col("n_et") * F.col("n") / (F.col("n_e") * F.col("n_t")))
    share = F.when(content > 0, mutual / content).otherwise(F.lit(0.0))
    given = pairs.withColumn("share", share).filter(F.col("share") >= generalise_at).select("e", "t", F.when(F.col("share") >= remove_at, "remove").otherwise("generalise").alias("action"))
    marked = held.select("k1", "k2", "e").join(given, "e").join(having.select("k1", "k2", "t", "terms"), ["k1", "k2", "t"])
    marked = marked.groupBy("k1", "k2", "t").agg(F.max("action").alias("action"), F.first("terms").alias("terms"))
    return marked.select("k1", "k2", F.explode("terms").alias("term"), "action")


def detect(docs: DataFrame, *, support: int = 3, generalise_at: float = 0.9, remove_at: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2, base and spans (arrays of start, kind, end, label, at) of each row that holds personal data: sorted by start
    and kind, code points, end exclusive; at is the largest end of the spans before. Added spans have kind len(KINDS) and
    never overlap base ones: all words of a text that give away an entity which it holds."""
    rows = keyed(docs, id_col, text_col)
    spans = written(base_spans(rows), "spans")  # a few columns of the rows that hold personal data; used twice
    texts = written(holders(rows, spans, support), "texts")
    marks = written(disclosures(rows, texts, support=support, generalise_at=generalise_at, remove_at=remove_at), "marks")
    labels = F.when(F.col("kind") == 0, "[EMAIL]").when(F.col("kind") == 1, "[IP]").when(F.col("kind") == 2, "[CARD]").otherwise("[PHONE]")
    own = spans.select("k1", "k2", F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"), labels.alias("label"))
    every = own.unionByName(term_spans(texts, marks))
    order, base = ("start", "kind", "end"), F.col("kind") < len(KINDS)
    up = Window.partitionBy("k1", "k2").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("k1", "k2").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("after", F.min(F.when(base, F.col("start"))).over(down)).withColumn("before", F.max(F.when(base, F.col("end"))).over(up))
    met = F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False))
    free = every.filter(base | ~met).withColumn("at", F.coalesce(F.max("end").over(up), F.lit(0)))
    grouped = free.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "label", "at"))).alias("spans"))
    return grouped.select("k1", "k2", F.filter("spans", lambda s: s["kind"] < len(KINDS)).alias("base"), "spans")


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; empty without spans."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base and spans (as text) of each row.

    A null text counts as empty and holds nothing. Null or repeated ids and repeated rows give a row each (equal rows
    count each in all shares, but as one towards `support`); an empty table gives an empty one; further columns are ignored.
    """
    rows = keyed(docs, id_col, text_col).select("doc_id", "k1", "k2")
    joined = rows.join(detect(docs, id_col=id_col, text_col=text_col, **settings), ["k1", "k2"], "left")

    def n(kind: int) -> Column:
        return F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")

    counts = [n(k).alias(f"n_{name}") for k, name in enumerate((*KINDS, TERM))]
    return joined.select("doc_id", *counts, written_out(F.col("base")).alias("base"), written_out(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, *, keep: list[str], id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The columns `keep` of `docs` with `text_col` rewritten: base spans become their kind, generalised terms [TERM],
    removed ones nothing. Spans that overlap are covered by the first one's label. A null text stays null."""
    names = [f"c{j}" for j in range(len(keep))]
    rows = keyed(docs, id_col, text_col, *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)])
    found = detect(docs, id_col=id_col, text_col=text_col, **settings).select("k1", "k2", "spans")
    joined = rows.join(found, ["k1", "k2"], "left")

    def rewritten(chars: Column) -> Column:
        """The text from its characters: what stands between spans, and their labels. Each character is taken once."""
        pieces = F.transform("spans", lambda s: F.when(s["start"] >= s["at"], F.concat(F.array_join(F.slice(chars, (s["at"] + 1).cast("int"), (s["start"] - s["at"]).cast("int")), ""), s["label"])).otherwise(""))
        end = F.array_max(F.transform("spans", lambda s: s["end"])).cast("int")
        return F.concat(F.array_join(pieces, ""), F.array_join(F.slice(chars, end + 1, F.size(chars)), ""))

    clean = F.get(F.transform(F.array(F.split("text", "")), rewritten), 0)
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean)
    cells = []
    for c, n in zip(keep, names, strict=True):
        cells.append((F.when(F.col(n).isNotNull(), clean) if c == text_col else F.col(n)).alias(c))
    return joined.select(*cells)
