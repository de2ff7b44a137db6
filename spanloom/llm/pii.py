"""Personal data: fixed patterns, and boosted trees over candidate spans, in DataFrame operations only.

Patterns give the base spans (kinds email, ip, card, phone), leftmost and non-overlapping for each kind;
spans that fail their kind's check (parts over 255, Luhn, numbers of digits) are dropped.

High-recall generators propose further, overlapping spans where no base span is: obfuscated addresses, and
runs of digits with any separators, each as every kind that it might be. Gradient-boosted trees judge them by
format (length, digits, groups, separators, checks) and context (neighbouring characters, words before).

Nothing is labelled, so the trees learn from what the patterns find, in forms that the patterns don't find. In
about TRAIN_TEXTS texts, chosen by a hash, base spans keep their surroundings and are written differently: addresses
with "at" and "dot" in brackets or words, numbers with other separators or without their sign (``disguised``). These
are the examples. Counter-examples are the same numbers spoilt (a changed digit, a part too large, too few digits) or
as another kind, and the proposals of texts without any base span that pass no check and follow no word of their kind.
A held-out part of these sets each kind's threshold, the least at which PRECISION of what is selected are examples;
a kind without one selects nothing. Of proposals of one place the likeliest kind counts.

Positions are code points, ends exclusive. Matches are located by splitting the text at them, and their starts are
summed in blocks, so a text with many matches stays linear, and patterns don't recurse over long texts. Defined results:
a null text has no spans; repeated rows are each answered; with too few examples the base spans
stand alone; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: An address starts where its local part does, or right behind the match before; labels are taken 200 at a time to keep the matcher's stack small.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}+@[A-Za-z0-9-]+(?:(?>(?:\.[A-Za-z0-9-]+){{1,200}}))+"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
#: First and last digits of runs of at least 12 digits with single separators.
CARD_FIRST = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?=(?:[\x20-]?[0-9]){11})"
CARD_LAST = "(?<=" + r"[0-9][\x20-]?" * 11 + r")[0-9](?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of further proposals.
ADDRESS = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\s?(?:@|\[at\]|\(at\)|\{at\}|\sat\s)\s?[a-z0-9-]{1,63}(?:\s?(?:\.|\[dot\]|\(dot\)|\sdot\s)\s?[a-z0-9-]{2,24}){1,4}"
NUMBER = r"(?<![A-Za-z0-9])[+(]?[0-9][0-9\x20().+-]{6,28}[0-9](?![A-Za-z0-9])"
CONTEXT = 24
WORDS = {"email": "mail|contact|write", "ip": "ip|server|host|addr", "card": "card|visa|credit|pay|karte|tarjeta", "phone": "phone|tel|call|fax|mobile|t[eé]l"}
#: Texts of which base spans and proposals are examples.
TRAIN_TEXTS = 20_000
LEAST_EXAMPLES = 20
TREES, DEPTH = 12, 4
PRECISION = 0.99
#: Starts that are summed at once.
BLOCK = 256
#: Letters of a stretch of text in which proposals and base spans meet.
NEAR = 512
#: Runs of digits and single or more separators, in which cards are looked for.
DIGITS = r"[0-9][0-9\x20-]{10,}[0-9]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once; a lambda's body computes what it takes from outside again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _starts(steps: Column) -> Column:
    """Where each match starts: sums of all (gap, length) before, in blocks; steps is a value of ``let``."""
    n = F.size(steps)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))

    def inner(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        return F.struct((s + x["l"]).alias("at"), F.concat(acc["out"], F.array(s)).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        one = F.aggregate(block, F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("out")), inner)
        return let(one, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")), outer, lambda acc: acc["out"]))


def located(text: Column, pattern: str) -> Column:
    """Array of (s, e, t, before, after) of the pattern's matches, in code points: the match and what stands around it."""
    none = F.array().cast(f"array<{SPAN}>")

    def spans(x: Column) -> Column:
        n = F.size(x["found"])
        steps = F.arrays_zip(F.transform(F.slice(x["pieces"], 1, n), F.char_length).alias("g"), F.transform(x["found"], F.char_length).alias("l"))
        around = F.arrays_zip(let(steps, _starts).alias("s"), x["found"].alias("t"), F.slice(x["pieces"], 1, n).alias("b"), F.slice(x["pieces"], 2, n).alias("a"))
        span = lambda y: F.struct(y["s"].alias("s"), (y["s"] + F.char_length(y["t"])).alias("e"), y["t"].alias("t"), F.right(y["b"], F.lit(CONTEXT)).alias("before"), F.left(y["a"], F.lit(2)).alias("after"))
        return F.when(n > 0, F.transform(around, span)).otherwise(none)

    return let(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), spans)


SPAN = "struct<s:int,e:int,t:string,before:string,after:string>"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def ip_valid(text: Column) -> Column:
    """Whether four parts are at most 255 each."""
    parts = F.split(text, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def digit_count_valid(text: Column, low: int, high: int) -> Column:
    return F.char_length(digits_of(text)).between(low, high)


def _cards(text: Column) -> Column:
    """Runs of at least 12 digits with single separators."""

    def runs(x: Column) -> Column:
        t = x["t"]
        ends = F.arrays_zip(located(t, CARD_FIRST).alias("a"), located(t, CARD_LAST).alias("z"))

        def span(y: Column) -> Column:
            s, e = y["a"]["s"], y["z"]["e"]
            before = F.right(F.concat(x["before"], F.substring(t, F.lit(1), s)), F.lit(CONTEXT))
            after = F.left(F.concat(F.substring(t, e + 1, F.lit(2)), x["after"]), F.lit(2))
            return F.struct((x["s"] + s).alias("s"), (x["s"] + e).alias("e"), F.substring(t, s + 1, e - s).alias("t"), before.alias("before"), after.alias("after"))

        return F.transform(ends, span)

    return F.flatten(F.transform(located(text, DIGITS), runs))


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of its spans."""
    none = F.array().cast(f"array<{SPAN}>")
    email = F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none)
    ip = F.when(text.rlike(IP), F.filter(located(text, IP), lambda x: ip_valid(x["t"]))).otherwise(none)
    card = F.when(text.rlike(CARD_FIRST), F.filter(_cards(text), lambda x: digit_count_valid(x["t"], 12, 19) & luhn(digits_of(x["t"])))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE), lambda x: digit_count_valid(x["t"], 9, 15))).otherwise(none)
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def joined(spans: Column) -> Column:
    """kind:start:end of spans (s, k, e), by start, kind and end."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _found(docs: DataFrame, id_col: str, text_col: str, every: int) -> DataFrame:
    """(doc_id, row, n_<kind>, base, proposed, shown): base spans (s, k, e); proposals; in one of ``every`` texts the base spans with their surroundings."""
    text = F.col("text")
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    none = F.array().cast(f"array<{SPAN}>")
    address = F.when(F.contains(text, F.lit("@")) | text.rlike(r"(?i)(?:[\[({]at[\])}]|\sat\s)"), located(text, ADDRESS)).otherwise(none)
    number = F.when(text.rlike("[0-9][0-9\\x20().+-]{6}"), located(text, NUMBER)).otherwise(none)
    rows = rows.select("doc_id", "row", *[c.alias(k) for k, c in base_spans(text).items()], address.alias("a_"), number.alias("n_"))
    kind = lambda spans, k: F.transform(spans, lambda x: F.struct(F.lit(k).alias("k"), *[x[n].alias(n) for n in ("s", "e", "t", "before", "after")]))
    every_base = F.concat(*[kind(F.col(n), i) for i, n in enumerate(KINDS)])
    rows = rows.select("doc_id", "row", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], every_base.alias("all"), "a_", "n_")
    proposed = F.concat(kind(F.col("a_"), 0), *[kind(F.col("n_"), k) for k in (1, 2, 3)])
    shown = F.when(F.pmod(F.col("row"), F.lit(every)) == 0, F.col("all"))
    return rows.select("doc_id", "row", *[f"n_{k}" for k in KINDS], F.transform("all", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias("base"), proposed.alias("proposed"), shown.alias("shown"))


def apart(found: DataFrame) -> DataFrame:
    """(doc_id, row, k, s, e, t, before, after): proposals that overlap no base span of their text. They meet by stretches of NEAR letters, longer than any proposal."""
    each = found.select("doc_id", "row", F.explode("proposed").alias("x")).select("doc_id", "row", "x.*").withColumn("near", F.floor(F.col("s") / NEAR))
    base = found.select(F.col("doc_id").alias("d_"), F.col("row").alias("r_"), F.explode("base").alias("b")).select("d_", "r_", F.col("b.s").alias("s_"), F.col("b.e").alias("e_"))
    base = base.withColumn("near_", F.explode(F.sequence(F.floor(F.col("s_") / NEAR) - 1, F.floor(F.col("e_") / NEAR))))
    on = F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("row") == F.col("r_")) & (F.col("near") == F.col("near_")) & (F.col("s_") < F.col("e")) & (F.col("s") < F.col("e_"))
    return each.join(base, on, "left_anti").drop("near")


def disguised(k: Column, text: Column, way: Column) -> Column:
    """A base span of kind k written in a form that its pattern doesn't find; ``way`` chooses the form (0 to 5)."""
    choose = lambda forms: F.element_at(F.array(*forms), way % len(forms) + 1)
    swap = lambda pattern, to: F.regexp_replace(text, pattern, to)
    at = [("[at]", "."), ("(at)", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("{at}", "."), (" (at) ", " (dot) ")]
    # the local part keeps its dots
    email = choose([F.concat(F.substring_index(text, "@", 1), F.lit(a), F.replace(F.substring_index(text, "@", -1), F.lit("."), F.lit(d))) for a, d in at])
    ip = choose([swap(r"\.", x) for x in (" . ", ". ", "-", " .")])
    card = choose([F.regexp_replace(digits_of(text), "(....)(?=.)", f"$1{x}") for x in (".", "  ", " - ", "--")])
    phone = choose([swap(r"\+", "00"), swap(r"\+", ""), swap(r"\+[0-9]+ ?", "0"), F.regexp_replace(swap(r"^\+", "00"), "[ ()-]+", ".")])
    return F.when(k == 0, email).when(k == 1, ip).when(k == 2, card).otherwise(phone)


def spoilt(k: Column, text: Column) -> Column:
    """The same number without what makes it one of its kind; null for addresses."""
    last = ((F.right(text, F.lit(1)).cast("int") + 1) % 10).cast("string")
    card = F.concat(F.expr("left(t, char_length(t) - 1)"), last)
    return F.when(k == 1, F.concat(F.lit("9"), text)).when(k == 2, card).when(k == 3, F.expr("left(regexp_replace(t, '[^0-9 ]', ''), 8)"))


def examples(found: DataFrame, seed: int) -> DataFrame:
    """(row, k, t, before, after, label) for the trees; see the module."""
    shown = found.where(F.size("shown") > 0).select("row", F.explode("shown").alias("x")).select("row", "x.*")
    way = F.pmod(F.xxhash64("row", "s", F.lit(seed)), F.lit(12)).cast("int")
    shown = shown.withColumn("way", F.explode(F.array(way, way + 1)))
    good = shown.withColumn("t", disguised(F.col("k"), F.col("t"), F.col("way")))
    row = ["row", "k", "t", "before", "after"]
    yes = good.select(*row, F.lit(1.0).alias("label"))
    bad = good.withColumn("t", spoilt(F.col("k"), F.col("t"))).where("t is not null").select(*row, F.lit(0.0).alias("label"))
    other = good.where("k > 0").withColumn("k", F.col("k") % 3 + 1).where("not (k = 3 and char_length(regexp_replace(t, '[^0-9]', '')) between 9 and 15)").select(*row, F.lit(0.0).alias("label"))
    plain = found.where("size(shown) = 0").select("row", F.explode("proposed").alias("x")).select("row", "x.*")
    no_word = F.lit(True)
    for i, k in enumerate(KINDS):
        no_word = no_word & ~((F.col("k") == i) & F.col("before").rlike(f"(?i)(?:{WORDS[k]})"))
    digits = digits_of(F.col("t"))
    fails = F.when(F.col("k") == 0, ~F.col("t").rlike(r"(?i)@|[\[({]at[\])}]|dot")).when(F.col("k") == 1, ~ip_like(F.col("t"))).when(F.col("k") == 2, ~luhn(digits)).otherwise(~F.col("t").rlike(r"^(?:\+|00)"))
    return yes.unionByName(bad).unionByName(other).unionByName(plain.where(no_word & fails).select(*row, F.lit(0.0).alias("label")))


def ip_like(text: Column) -> Column:
    """Whether the digits stand in four groups of at most 255 each."""
    parts = F.filter(F.split(text, "[^0-9]+"), lambda p: p != "")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def features() -> dict[str, Column]:
    t, digits = F.col("t"), digits_of(F.col("t"))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("double")
    words = F.lit(False)
    for i, k in enumerate(KINDS):
        words = words | ((F.col("k") == i) & F.col("before").rlike(f"(?i)(?:{WORDS[k]})"))
    return {
        "f_kind": F.col("k").cast("double"), "f_length": F.char_length(t).cast("double"), "f_digits": F.char_length(digits).cast("double"), "f_groups": count("[0-9]+"),
        "f_dots": count(r"\."), "f_dashes": count("-"), "f_blanks": count(r"\s"), "f_brackets": count(r"[()\[\]]"), "f_letters": count("[A-Za-z]"), "f_at": count("@"),
        "f_upper": count("[A-Z]"), "f_hidden": flag(t.rlike(r"(?i)[\[({]\s?(?:at|dot)\s?[\])}]|\sdot\s")), "f_ends": flag(t.rlike(r"\.\s?[a-z]{2,6}$")), "f_stop": flag(t.rlike(r"[.!?]\s+[A-Z]")),
        "f_plus": flag(t.startswith("+")), "f_zeros": flag(t.rlike("^0")), "f_luhn": flag(luhn(digits)), "f_ip": flag(ip_like(t)), "f_doubled": flag(t.rlike(r"[\x20().+-]{2}")),
        "f_same": flag(t.rlike(r"^[^0-9]*([0-9])(?:[^0-9]*\1)*[^0-9]*$")), "f_words": flag(words),
        "f_before": flag(F.col("before").rlike(r"[A-Za-z0-9+.-]$")), "f_after": flag(F.col("after").rlike("^[A-Za-z0-9%-]")),
    }


def _selected(found: DataFrame, seed: int, told: dict[str, float] | None) -> DataFrame | None:
    """(doc_id, row, s, k, e) of proposals that the trees select, or None without enough examples."""
    names = list(features())
    sample = written(examples(found, seed).withColumns(features()).withColumn("part", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(4))).select("part", "k", "label", *names), "pii-sample")
    seen = {(r.held, r.label): r.n for r in sample.groupBy((F.col("part") == 0).alias("held"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(seen.get((held, label), 0) < LEAST_EXAMPLES for held in (True, False) for label in (0.0, 1.0)):
        discard(sample)
        return None
    vector = VectorAssembler(inputCols=names, outputCol="vector")
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=seed, cacheNodeIds=False).fit(vector.transform(sample.where("part > 0")))
    score = lambda df: model.transform(vector.transform(df)).withColumn("p", vector_to_array("probability")[1])
    bins = score(sample.where("part = 0")).groupBy("k", F.floor(F.col("p") * 100).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("yes")).collect()
    discard(sample)
    passes, chosen, right = F.lit(False), 0.0, 0.0
    for k in range(len(KINDS)):
        n = yes = 0.0
        least, best = None, (0.0, 0.0)
        for r in sorted((r for r in bins if r.k == k), key=lambda r: -r.bin):
            n, yes = n + r.n, yes + r.yes
            if r.bin >= 50 and yes >= PRECISION * n:
                least, best = r.bin / 100, (n, yes)
        if least is not None:
            passes = passes | ((F.col("k") == k) & (F.col("p") >= least))
        chosen, right = chosen + best[0], right + best[1]
    if told is not None:
        told |= {"examples": sum(seen.values()), "held_precision": right / chosen if chosen else 1.0, "held_recall": right / max(1.0, sum(r.yes for r in bins))}
    each = apart(found.where(F.size("proposed") > 0)).withColumns(features())
    likeliest = score(each).where(passes).groupBy("doc_id", "row", "s", "e").agg(F.max_by("k", F.struct("p", -F.col("k"))).alias("k"))
    return likeliest.select("doc_id", "row", "s", "k", "e")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, told: dict[str, float] | None = None) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added. ``told`` gets the trees' precision and recall on held-out examples."""
    found = written(_found(docs, id_col, text_col, max(1, docs.count() // TRAIN_TEXTS)), "pii-found")
    more = _selected(found, seed, told)
    out = found.select("doc_id", "row", *[f"n_{k}" for k in KINDS], "base")
    if more is None:
        out = out.withColumn("more", F.array().cast("array<struct<s:int,k:int,e:int>>"))
    else:
        more = more.groupBy("doc_id", "row").agg(F.collect_set(F.struct("s", "k", "e")).alias("more")).select(F.col("doc_id").alias("d_"), F.col("row").alias("r_"), "more")
        more = written(more, "pii-more")
        out = out.join(more, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("row") == F.col("r_")), "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int>>")))
    every = F.concat("base", "more")
    return out.select(F.col("doc_id").alias(id_col), *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size(every).cast("bigint").alias("n_spans"), F.size("more").cast("bigint").alias("n_added"))
