"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Fixed patterns with checks give the base spans (email, ip, card, phone). They are the seeds. Every identifier-like token of
the corpus is a candidate, with two lexical patterns: the two words before it, and the word before with the word after it.
So is every stretch of numbers that single spaces, dots, hyphens and brackets join, as a whole: an identifier that only a space
parts from another number isn't told from it. A stretch whose first part is a candidate itself doesn't count in shares.
A run of fewer than six characters, and a stretch of fewer than ``LEAST`` or more than ``MOST`` digits, is no candidate.
Over the graph of patterns and candidate texts (distinct edges, all documents), each round scores a pattern for a kind by
the share of its texts known to be of that kind, accepts patterns with ``SUPPORT`` known texts and a share of
``CONFIDENCE``, and joins the accepted patterns' scores into a score of each unseen text (noisy or); texts that reach
``ACCEPT`` and fit the kind's form become known. Rounds go on until one finds nothing. Then every candidate that lies outside
the base spans and whose text is known by its context becomes a span of its own, but for those within another such span.

Joins by a text or pattern that may stand on many rows are salted for the frequent ones. No side is marked for a broadcast:
Spark broadcasts a side only under its own limit of size.

Positions come from splitting a text by a pattern: the lengths of the parts and of the matches between them add up to
starts and ends in code points. All quantifiers over groups are possessive, so long runs need no stack. The work in a row grows with its text and
its candidates: sums run over blocks, contexts are cut from pieces of the text, and base spans are found by halving.

Defined results: null and empty texts have no spans; equal rows each get a result; null ids are kept; input columns named
like an added one are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Staging, frequent_of, salted_join, table, whole_text

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A run is only tried from its beginning, or from the end of the last match within it.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
_SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Runs of six characters and more without white space, quotes and brackets that hold a digit or an at sign.
CANDIDATE = r"(?:\G|(?<![^\s\"'<>(){}\[\],;=]))(?=[^\s\"'<>(){}\[\],;=]{6})[^\s\"'<>(){}\[\],;=0-9@]*+[0-9@][^\s\"'<>(){}\[\],;=]*+"
#: Numbers joined by single spaces, dots, hyphens and brackets; bracketed ones are followed by a plain one.
_JOINT, _NUMBER = r"(?:\x20?[.-]\x20?|\x20)?+", r"[0-9]++(?![\p{L}_@])"
_PART = rf"(?:\([0-9]++\){_JOINT})?+{_NUMBER}"
SPACED = rf"(?<![\p{{L}}\p{{N}}_@+])\+?+{_PART}(?:{_JOINT}{_PART})++"
#: Digits of a candidate made of several numbers: the least of a phone, the most of a card.
LEAST, MOST = 7, 19
SUPPORT, CONFIDENCE, ACCEPT = 5, 0.8, 0.9
#: Characters on either side in which context words are looked for first; where a word is cut, the next reach is tried, then the whole text.
REACHES = (48, 1 << 8, 1 << 16)
#: Texts are also held in pieces of so many characters, in which places are found.
PIECES = (1 << 8, 1 << 16)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    each = F.filter(F.split(F.reverse(_digits(match)), ""), lambda c: c != "")
    return F.aggregate(F.transform(each, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(match: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(plain) <= 3) & (F.coalesce(plain.cast("int"), F.lit(999)) <= 255)

    return F.forall(F.split(match, r"\."), small)


def _holds(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    return {
        "email": F.lit(True),
        "ip": _small_parts(match) if kind == "ip" else None,
        "card": F.when(n.between(16, 19), _luhn(match)).otherwise(False),
        "phone": n.between(8, 15),
    }[kind]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: what stands in a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefixes(numbers: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """Of an array of whole numbers: for each of them, the sum (by plus, from 0) of those before it.

    Appending copies an array, so the numbers are summed up in blocks of about the root of their number, then the blocks' sums.
    """
    ints = "array<int>"

    def fold(block: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast(ints).alias("out"))
        return F.aggregate(block, first, lambda a, x: F.struct(plus(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def in_blocks(v: Column) -> Column:
        edge = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = let(edge, lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / e).cast("int")), lambda k: fold(F.slice(v, k * e + 1, e))))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, fold(F.transform(b, lambda x: x["at"]))["out"], lambda x, o: F.transform(x["out"], lambda y: plus(o, y)))))

    return let(numbers, lambda v: F.when(F.size(v) <= 32, fold(v)["out"]).otherwise(in_blocks(v)))


def located(text: Column, pattern: str) -> Column:
    """All matches in order: array<struct<match,start,end>>."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<match:string,start:int,end:int>>)")

    def placed(m: Column) -> Column:
        around = F.zip_with(m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda x, before: F.struct(x.alias("match"), F.length(before).alias("gap"), F.length(x).alias("size")))
        return let(around, lambda a: F.zip_with(a, prefixes(F.transform(a, lambda x: x["gap"] + x["size"]), lambda p, q: p + q), lambda x, at: F.struct(x["match"].alias("match"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"))))

    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def base_matches(text: Column, kind: str) -> Column:
    """Checked matches of one kind: array<struct<match,start,end>>."""
    none = F.expr("cast(array() as array<struct<match:string,start:int,end:int>>)")
    may = F.contains(text, F.lit(_SIGN[kind])) if _SIGN[kind] else text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
    return F.when(may, F.filter(located(text, PATTERNS[kind]), lambda m: _holds(kind, m["match"]))).otherwise(none)


def as_spans(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))).cast(SPANS)


def base_spans(text: Column, kind: str) -> Column:
    """Checked matches of one kind: array<struct<kind,start,end>>."""
    return as_spans(base_matches(text, kind), kind)


def pieces(text: Column, size: int) -> Column:
    """The text in pieces of so many characters, so that a place in it is found without reading what stands before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def cut(parts: Column, size: int, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in pieces."""
    i, j = F.floor(start / size).cast("int"), F.floor(end / size).cast("int")
    first, last = F.coalesce(F.get(parts, i), F.lit("")), F.coalesce(F.get(parts, j), F.lit(""))
    inner = F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    apart = F.concat(F.substring(first, start % size + 1, F.lit(size)), inner, F.substring(last, F.lit(1), end % size))
    return F.when(end <= start, F.lit("")).when(i == j, F.substring(first, start % size + 1, end - start)).otherwise(apart)


def _patterns(small: Column, large: Column, length: Column, start: Column, end: Column) -> Column:
    """The two lexical patterns around a span, of whole words: in the nearest characters, or else in more of them.

    small and large are the text in pieces of the two sizes of ``PIECES``.
    """

    def first(own: Column, otherwise: Column, all_there: Column, cut_off: Callable[[Column, Column], Column]) -> Column:
        return let(own, lambda o: F.when(all_there | ~cut_off(o["f"], o["w"]), o["f"]).otherwise(otherwise))

    def whole(found: Callable[[Column], Column], window: Callable[[int], Column], there: Column, cut_off: Callable[[Column, Column], Column]) -> Column:
        """What is found in the window of least reach that is all there is, or doesn't cut it off."""
        out = found(window(1 << 30))
        for reach in reversed(REACHES):
            own = let(window(reach), lambda w: F.struct(w.alias("w"), found(w).alias("f")))
            out = first(own, out, there <= reach, cut_off)
        return out

    def before(reach: int) -> Column:
        parts, size = (small, PIECES[0]) if reach <= PIECES[0] else (large, PIECES[1])
        return F.lower(cut(parts, size, F.greatest(start - reach, F.lit(0)), start))

    def after(reach: int) -> Column:
        parts, size = (small, PIECES[0]) if reach <= PIECES[0] else (large, PIECES[1])
        return F.lower(cut(parts, size, end, F.least(end + reach, length)))

    def at_edge(f: Column, w: Column) -> Column:
        return F.length(f) == F.length(w)

    last1 = whole(lambda w: F.regexp_extract(w, r"(?:^|(?<!\S)(?=\S))(\S*+\s*+)$", 1), before, start, lambda f, w: at_edge(f, w) | (f == ""))
    last2 = whole(lambda w: F.regexp_extract(w, r"(?<!\S)(\S++\s++\S*+\s*+)$", 1), before, start, lambda f, w: at_edge(f, w) | (f == ""))
    next1 = whole(lambda w: F.regexp_extract(w, r"^(\s*+\S*+)", 1), after, length - end, at_edge)
    return F.array(F.concat(F.lit("2|"), last2), F.concat(F.lit("1|"), last1, F.lit("|"), next1))


def _meets(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of these spans, which are in order and apart from each other, meets the one from start to end: by halving."""
    size = F.size(spans)
    none = F.struct(F.lit(0).alias("low"), size.alias("high"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["low"] + a["high"]) / 2).cast("int")
        less = F.coalesce(F.get(spans, mid)["start"] < end, F.lit(False)) & (a["low"] < a["high"])
        return F.struct(F.when(less, mid + 1).otherwise(a["low"]).alias("low"), F.when(less, a["high"]).otherwise(F.least(a["high"], mid)).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    before = F.aggregate(steps, none, halve)["low"]  # so many begin before the end
    return F.when(size == 0, False).otherwise(F.coalesce(F.get(spans, before - 1)["end"] > start, F.lit(False)))


def _candidates(text: Column, small: Column, large: Column, length: Column, base: dict[str, Column]) -> Column:
    """array<struct<token,start,end,patterns,seed,main>>: the base matches with their kind, and the identifier-like tokens and stretches of numbers outside of them.

    All columns but text must be plain ones: they stand in lambdas.
    """

    def plain(token: Column, m: Column, end: Column, main: Column, kind: str | None = None) -> Column:
        return F.struct(token.alias("token"), m["start"].alias("start"), end.alias("end"), F.lit(kind).cast("string").alias("seed"), main.alias("main"))

    def short(m: Column) -> Column:
        token = F.rtrim(m["match"], F.lit(".:!?"))
        return plain(token, m, m["start"] + F.length(token), F.lit(True))

    def outside(c: Column) -> Column:
        met = F.lit(False)
        for spans in base.values():
            met = met | _meets(spans, c["start"], c["end"])
        return (F.length(c["token"]) >= 6) & ~met

    def stretch(m: Column) -> Column:
        return plain(m["match"], m, m["end"], F.length(F.regexp_extract(m["match"], r"^[^\x20()]*", 0)) < 6)

    def fine(m: Column) -> Column:
        return F.length(_digits(m["match"])).between(LEAST, MOST) & m["match"].rlike(r"[\x20(]")

    def seeds(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda m: plain(m["match"], m, m["end"], F.lit(True), kind))

    def entry(c: Column) -> Column:
        around = _patterns(small, large, length, c["start"], c["end"])
        return F.struct(c["token"].alias("token"), c["start"].alias("start"), c["end"].alias("end"), around.alias("patterns"), c["seed"].alias("seed"), c["main"].alias("main"))

    found = F.concat(F.transform(located(text, CANDIDATE), short), F.transform(F.filter(located(text, SPACED), fine), stretch))
    return F.transform(F.concat(*[seeds(spans, kind) for kind, spans in base.items()], F.filter(found, outside)), entry)


def _fits(kind: Column, token: Column) -> Column:
    """Whether a text may be an identifier of this kind, by its form."""
    n = F.length(_digits(token))
    return (
        F.when(kind == "email", F.contains(token, F.lit("@")))
        .when(kind == "ip", (n >= 4) & token.rlike(r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,}$"))
        .when(kind == "card", n.between(12, 19) & token.rlike(r"^[0-9().\x20-]+$"))
        .when(kind == "phone", n.between(7, 15) & token.rlike(r"^[+0-9().\x20-]+$"))
        .otherwise(False)
    )


def scanned(docs: DataFrame) -> DataFrame:
    """_row, the columns of docs, base (spans of the four kinds in order) and cands."""
    text, may = whole_text(), whole_text().rlike("[0-9@]")
    rows = docs.withColumns({"_row": F.monotonically_increasing_id()} | {f"_{k}": base_matches(text, k) for k in KINDS})
    rows = rows.withColumns({"_small": F.when(may, pieces(text, PIECES[0])), "_large": F.when(may, pieces(text, PIECES[1])), "_length": F.length(text)})
    found = _candidates(text, F.col("_small"), F.col("_large"), F.col("_length"), {k: F.col(f"_{k}") for k in KINDS})
    rows = rows.withColumns({"base": F.concat(*[as_spans(F.col(f"_{k}"), k) for k in KINDS]), "cands": F.when(may, found)})
    return rows.drop(*[f"_{k}" for k in KINDS], "_small", "_large", "_length")


def discovered(rows: DataFrame, staging: Staging) -> DataFrame:
    """(_row, extra) with the spans that context adds, of rows with _row and cands."""
    each = staging.write(rows.select("_row", F.explode("cands").alias("c")).select("_row", "c.*"), "candidates")
    edges = each.select("token", "main", F.explode("patterns").alias("pattern")).where("pattern not in ('2|', '1||')")
    edges = staging.write(edges.groupBy("token", "pattern").agg(F.max("main").alias("main")), "edges")
    seeds = staging.write(each.where("seed is not null").groupBy("token").agg(F.min("seed").alias("kind")), "seeds")
    total = staging.write(edges.where("main").groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= SUPPORT), "totals")
    hot_token, hot_pattern = frequent_of(edges, "token"), frequent_of(edges, "pattern")
    known, new, step = seeds, seeds, 0
    while not new.isEmpty():
        hits = salted_join(edges.where("main"), known, "token", hot_token).groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= SUPPORT)
        good = hits.join(total, "pattern").withColumn("score", F.col("hits") / F.col("total")).where(F.col("score") >= CONFIDENCE)
        good = staging.write(good.select("pattern", "kind", "score"), f"patterns{step}")
        unseen = salted_join(edges, known.withColumn("old", F.lit(True)), "token", hot_token, "left").where("old is null").select("token", "pattern")
        unseen = salted_join(unseen, good, "pattern", hot_pattern).where(_fits(F.col("kind"), F.col("token")))
        scores = unseen.groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("score"))
        new = staging.write(scores.where(F.col("score") >= ACCEPT).groupBy("token").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")), f"found{step}")
        known, step = known.unionByName(new), step + 1
    added = salted_join(each.where("seed is null").select("token", "_row", "start", "end"), known.join(seeds.select("token"), "token", "left_anti"), "token", frequent_of(each, "token"))
    added = added.select("_row", F.struct("kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("span"))
    return added.groupBy("_row").agg(_widest(F.collect_list("span")).alias("extra"))


def _by_start(spans: Column) -> Column:
    """By start, the longest first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    return F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["less"]).alias("end")))


def _reached(spans: Column) -> Column:
    """How far the spans before each one reach."""
    return prefixes(F.transform(spans, lambda s: s["end"]), F.greatest)


def _widest(spans: Column) -> Column:
    """The spans, by kind and start, without those that lie within another one."""

    def kept(s: Column) -> Column:
        each = F.zip_with(s, _reached(s), lambda x, far: F.when(x["end"] > far, x))
        return F.filter(each, lambda x: x.isNotNull())

    return F.array_sort(let(_by_start(spans), kept)).cast(SPANS)


def _of(spans: Column | str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _in_order(spans: Column) -> Column:
    """Spans by kind as listed, then start."""
    return F.flatten(F.array(*[F.array_sort(_of(spans, k)) for k in KINDS]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """The columns of docs, base and spans; columns so named are replaced."""
    staging = Staging(docs.sparkSession, "pii")
    docs = docs.drop("base", "spans")
    safe = [c if c == "text" else f"_own{i}" for i, c in enumerate(docs.columns)]
    rows = staging.write(scanned(docs.toDF(*safe)), "rows")
    both = rows.join(discovered(rows, staging), "_row", "left")
    spans = F.concat("base", F.coalesce("extra", F.expr(f"cast(array() as {SPANS})")))
    return both.select(*safe, "base", _in_order(spans).alias("spans")).toDF(*docs.columns, "base", "spans")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""

    def replaced(parts: Column) -> Column:
        def one(s: Column, far: Column) -> Column:
            return F.when(s["start"] >= far, F.concat(cut(parts, PIECES[0], far, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")

        def joined(s: Column) -> Column:
            return F.concat(F.array_join(F.zip_with(s, _reached(s), one), ""), cut(parts, PIECES[0], F.array_max(F.transform(s, lambda x: x["end"])), F.length(text)))

        return let(_by_start(spans), joined)

    return F.when(F.size(spans) > 0, let(pieces(text, PIECES[0]), replaced)).otherwise(text)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(_of("base", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data in the texts is replaced by its kind."""
    safe = [c if c == "text" else f"own{i}" for i, c in enumerate(docs.columns)]
    done = find_pii(docs.toDF(*safe)).withColumn("text", redacted(F.col("text"), F.col("spans")))
    return done.select(*safe).toDF(*docs.columns)
