"""Queries on scalar functions: normalisers and parsers over the conversations' whole texts and a list of typical answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import hashing as h
from plumbline.functions import scores
from plumbline.functions import text as tx
from plumbline.plans import synth
from plumbline.plans.registry import query

ANSWERS = (
    "Yes", "yes", "YES.", "Yeah", "yep", "Yes, the object is there.", "No", "no.", "nope", "No, I do not see it.", "maybe", "I am not sure", "True", "true.", "Correct", "False", "Incorrect", "uncertain",
    "  A Cat  ", "it's a dog!", "the red car", "red    car", "unanswerable", "I don't know", "cannot be determined", "0", "1", "2", "nothing", "North", "an apple, the pear", "n/a", "Unsure.", "right",
)
STATEMENTS = (
    "The cat is above the table.", "The dog is to the Left of the chair.", "A cup is in front of the book", "Behind the car stands a tree", "What color is this object?", "It is above the table and left of the chair", "The man left the room.",
    "Is the answer right?", "The cat is not not above the mat", "The cat is not above the mat", "The box is on top of the shelf", "Under the bed", "The lamp is right of the sofa", "Turn right now", "The bird is below the cloud",
)
QUESTIONS = (
    "which country has the most?", "According to the table, which row is largest?", "According to the image, which month is it?", "According to the image which is about Euler's Number, does it hold?", "Is the sky blue?",
    "  What is this?", "How many are there", "However it is, is it so?", "according to chart , who won", "Does it hold?",
)
GROUNDED = (
    "A dog.\nFINAL_ANSWER: yes", "A dog.\nFINAL_ANSWER: banana", "A dog runs.\nYes", "", "I see it. The answer is yes.", "Seen.\nThe answer is **aspirin**", "a bottle\naspirin", "Seen.\nThe answer is yes or no", "Seen.\nFINAL_ANSWER:", "x\nFINAL ANSWER: Unknown",
    "A picture of a logo.\n\nMVG", "so that the answer is no - it cannot be", "FINAL_ANSWER: 1", "Is it?\n\nreally, is it?", "ANSWER: the red car\nand more", "nothing to see",
)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _listed(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


def _pick(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def texts(spark, sf):
    """(id, x): every text of the conversations, and as many typical answers."""
    c = synth.table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("x"))
    return c.unionByName(c.select((F.col("id") + 1_000_000_000).alias("id"), _pick(ANSWERS, F.col("id")).alias("x")))


_T = f"""WITH c AS (SELECT conv_id * 100 + turn AS id, coalesce(text, '') AS x FROM conversations), t AS (SELECT * FROM c UNION ALL SELECT id + 1000000000, {_listed(ANSWERS)}[id % {len(ANSWERS)} + 1] FROM c),
p AS (SELECT id, x, rtrim(lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '.') AS plain, lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS low FROM t), f AS (SELECT *, regexp_extract(plain, '^(\\S*)', 1) AS w FROM p)"""
_YES, _NO = (", ".join(map(_quoted, x)) for x in (tx.YES, tx.NO))
_SYES = f"CASE WHEN w IN ({_YES}) OR plain IN ({_YES}) THEN 'yes' WHEN w IN ({_NO}) OR plain IN ({_NO}) THEN 'no' WHEN plain LIKE 'yes%' THEN 'yes' WHEN plain LIKE 'no%' THEN 'no' ELSE 'unknown' END"
_UNC = ", ".join(map(_quoted, tx.UNCERTAIN))
_SNUM = f"CASE WHEN plain = '0' THEN 'no' WHEN plain = '1' THEN 'yes' WHEN plain IN ({_UNC}) OR w IN ({_UNC}) THEN 'uncertain' ELSE {_SYES} END"
_STRUE = f"CASE WHEN w IN ({', '.join(map(_quoted, tx.TRUE))}) THEN 'true' WHEN w IN ({', '.join(map(_quoted, tx.FALSE))}) THEN 'false' ELSE 'unknown' END"
_UNA = ", ".join(map(_quoted, tx.UNANSWERABLE))
_KEPT = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(low, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda v: v NOT IN ('', 'a', 'an', 'the')), ' ')"
_SFREE = f"CASE WHEN low IN ({_UNA}) OR {_KEPT} IN ('', {_UNA}) THEN 'unanswerable' ELSE {_KEPT} END"


def _scalar(name, sql, f):
    @query(name, f"{_T} SELECT id, {sql} AS norm FROM f")
    def run(spark, sf):
        return texts(spark, sf).select("id", f(F.col("x")).alias("norm"))


_scalar("yes_no_norm", _SYES, tx.yes_no)
_scalar("numeric_binary_norm", _SNUM, tx.numeric_binary)
_scalar("true_false_norm", _STRUE, tx.true_false)
_scalar("freeform_norm", _SFREE, tx.freeform)
_scalar("truth_label", "CASE WHEN lower(x) IN ('1', 'true') THEN 'true' ELSE 'false' END", tx.truth_label)

_DS = ("HallusionBench", "pope", "vizwiz vqa", "VSR", "pre-hal")


@query("normalise_dispatch", f"{_T}, d AS (SELECT *, {_listed(_DS)}[id % 5 + 1] AS ds FROM f) SELECT id, ds, CASE ds WHEN 'HallusionBench' THEN {_SNUM} WHEN 'vizwiz vqa' THEN {_SFREE} WHEN 'VSR' THEN {_STRUE} ELSE {_SYES} END AS norm FROM d")
def normalise_dispatch(spark, sf):
    rows = texts(spark, sf).withColumn("ds", _pick(_DS, F.col("id")))
    return rows.select("id", "ds", tx.normalise(F.col("x"), F.col("ds")).alias("norm"))


_Q = f"WITH q AS (SELECT conv_id * 100 + turn AS id, {_listed(QUESTIONS)}[(conv_id * 100 + turn) % {len(QUESTIONS)} + 1] || ' ' || coalesce(text, '') AS x FROM conversations)"


def _questions(spark, sf):
    c = synth.table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    return c.select("id", F.concat(_pick(QUESTIONS, F.col("id")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("x"))


@query("answer_type", rf"{_Q} SELECT id, CASE WHEN regexp_matches(trim(regexp_replace(trim(x), '^according\s+to\s+(?:the\s+)?(?:image|table|chart)\s*,\s*', '', 'i')), '^(?:which|what|who|where|when|how)\b', 'i') THEN 'open_ended' ELSE 'binary' END AS kind FROM q")
def answer_type(spark, sf):
    return _questions(spark, sf).select("id", tx.answer_type(F.col("x")).alias("kind"))


@query("prompts", f"""{_Q}, d AS (SELECT *, {_listed(_DS)}[id % 5 + 1] AS ds FROM q) SELECT id, sha256(CASE WHEN ds = 'vizwiz vqa' OR id % 7 = 0 THEN x || chr(10) || 'Answer the question concisely.'
  WHEN ds = 'VSR' THEN 'Is the following statement true or false?' || chr(10) || 'Statement: ' || x || chr(10) || 'Answer with exactly one word: true or false.' ELSE x || chr(10) || 'Answer with exactly one word: yes or no.' END) AS digest FROM d""")  # fmt: skip
def prompts(spark, sf):
    rows = _questions(spark, sf).withColumn("ds", _pick(_DS, F.col("id")))
    kind = F.when(F.col("id") % 7 == 0, "open_ended").otherwise("binary")
    return rows.select("id", h.sha256_hex(tx.prompt(F.col("x"), F.col("ds"), kind)).alias("digest"))


@query("gold_binary", f"{_T} SELECT id, CASE WHEN low IN ('0', 'no') THEN 'no' WHEN low IN ('1', 'yes') THEN 'yes' WHEN low IN ('2', 'uncertain') THEN 'uncertain' END AS gold FROM f")
def gold_binary(spark, sf):
    return texts(spark, sf).select("id", tx.gold_binary(F.col("x")).alias("gold"))


@query("source_keys", "SELECT s_suppkey, trim(s_name) || '|' || CAST(s_nationkey AS VARCHAR) || '|' || CAST(s_suppkey AS VARCHAR) AS key FROM supplier")
def source_keys(spark, sf):
    return synth.table(spark, sf, "supplier").select("s_suppkey", tx.source_key(F.col("s_name"), F.col("s_nationkey"), F.col("s_suppkey")).alias("key"))


_REL = "(?:in front of|on top of|behind|above|below|right|under|left)"
_SWAPS = f"""WITH t AS (SELECT conv_id * 100 + turn AS id, {_listed(STATEMENTS)}[(conv_id * 100 + turn) % {len(STATEMENTS)} + 1] AS x FROM conversations UNION ALL SELECT conv_id * 100 + turn + 1000000000, coalesce(text, '') FROM conversations),
r AS (SELECT *, regexp_extract_all(lower(x), '\\b{_REL}\\b') AS found FROM t)"""


def _statements(spark, sf):
    c = synth.table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return c.select("id", _pick(STATEMENTS, F.col("id")).alias("x")).unionByName(c.select((F.col("id") + 1_000_000_000).alias("id"), F.col("text").alias("x")))


@query("find_relations", f"{_SWAPS} SELECT id, array_to_string(found, ',') AS relations, CAST(len(found) AS INTEGER) AS n FROM r")
def find_relations(spark, sf):
    found = tx.relations(F.col("x"))
    return _statements(spark, sf).select("id", F.array_join(found, ",").alias("relations"), F.size(found).alias("n"))


@query("negation_count", r"WITH t AS (SELECT conv_id * 100 + turn AS id, lower(coalesce(text, '')) AS x FROM conversations) SELECT id, CAST(len(regexp_extract_all(x, '\b(?:not|no|never|neither|nor)\b')) AS INTEGER) AS n FROM t")
def negation_count(spark, sf):
    c = synth.table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), tx.negations(F.coalesce("text", F.lit(""))).alias("n"))


_OPP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in tx.OPPOSITES.items()) + "}"


def _unspatial(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower({x}), '{p.replace(chr(39), chr(39) * 2)}')" for p in tx.NOT_SPATIAL) + ")"


def _put(x: str, at: str, old: str, new: str) -> str:
    """The relation at a place of a text replaced, keeping a capital."""
    first = f"substr({x}, {at}, 1)"
    return f"substr({x}, 1, {at} - 1) || CASE WHEN {first} <> lower({first}) THEN upper(substr({new}, 1, 1)) || substr({new}, 2) ELSE {new} END || substr({x}, {at} + length({old}))"


def _at(x: str) -> str:
    return f"length(regexp_extract(lower({x}), '(?s)^(.*?)\\b{_REL}\\b', 1)) + 1"


_NEG = r"\b(?:not|no|never|neither|nor)\b"
_SWAP = f"""{_SWAPS}, a AS (SELECT id, x, found, CASE WHEN id % 2 = 0 THEN 'true' END AS gold, {_OPP}[found[1]] AS to_, {_at("x")} AS at_ FROM r),
b AS (SELECT *, {_put("x", "at_", "found[1]", "to_")} AS new FROM a), c AS (SELECT *, regexp_extract_all(lower(new), '\\b{_REL}\\b') AS again, {_at("new")} AS at2 FROM b),
d AS (SELECT *, coalesce(NOT {_unspatial("new")} AND len(again) = 1 AND len(regexp_extract_all(lower(new), '{_NEG}')) <= 1 AND again[1] = to_ AND {_put("new", "at2", "again[1]", "found[1]")} = x, false) AS fits FROM c),
e AS (SELECT *, CASE WHEN {_unspatial("x")} THEN 'non_spatial_usage_detected' WHEN len(found) = 0 THEN 'no_reversible_relation_found' WHEN len(found) > 1 THEN 'multiple_relations_found' WHEN len(regexp_extract_all(lower(x), '{_NEG}')) > 1 THEN 'ambiguous_negation' WHEN NOT fits THEN 'round_trip_failed' END AS reason FROM d),
k AS (SELECT *, reason IS NULL OR reason = 'round_trip_failed' AS known FROM e)"""


@query("relation_swap", f"{_SWAP} SELECT id, reason IS NULL AS applicable, CASE WHEN known THEN new END AS swapped_text, CASE WHEN known THEN found[1] END AS relation, CASE WHEN known THEN to_ END AS swapped_to, CASE WHEN known AND gold = 'true' THEN 'false' END AS swapped_gold, reason FROM k")
def relation_swap(spark, sf):
    rows = _statements(spark, sf)
    swap = tx.swap_relation(F.col("x"), F.lit(None).cast("string"), F.when(F.col("id") % 2 == 0, "true"))
    return rows.withColumn("s", swap).select("id", "s.*")


_SW = """WITH a AS (SELECT c_custkey AS id, c_custkey % 5 <> 0 AS ok, ['true', 'false', 'unknown', 'yes'][c_custkey % 4 + 1] AS o, ['true', 'false', 'maybe', 'no', 'false'][c_custkey % 5 + 1] AS s, ['true', 'false'][c_custkey % 2 + 1] AS g, ['false', 'true', 'true'][c_custkey % 3 + 1] AS sg FROM customer),
n AS (SELECT id, ok, CASE WHEN o IN ('true', 'yes') THEN 'true' WHEN o = 'false' THEN 'false' ELSE 'unknown' END AS o, CASE WHEN s = 'true' THEN 'true' WHEN s IN ('false', 'no') THEN 'false' ELSE 'unknown' END AS s, g, sg FROM a),
r AS (SELECT id, CASE WHEN NOT ok OR g = sg OR s = 'unknown' THEN 'invalid' WHEN s = sg THEN 'changed_correctly' WHEN s = o THEN 'invariant' ELSE 'changed_incorrectly' END AS status FROM n)"""


@query("swap_outcome", f"{_SW} SELECT id, status, CASE WHEN status = 'invariant' THEN 'true' WHEN status = 'changed_correctly' THEN 'false' ELSE 'void' END AS invariant FROM r")
def swap_outcome(spark, sf):
    n = F.col("c_custkey")
    status = tx.swap_status(n % 5 != 0, _pick(("true", "false", "unknown", "yes"), n), _pick(("true", "false", "maybe", "no", "false"), n), _pick(("true", "false"), n), _pick(("false", "true", "true"), n))
    return synth.table(spark, sf, "customer").select(n.alias("id"), status.alias("status")).withColumn("invariant", F.coalesce(tx.swap_invariance(F.col("status")).cast("string"), F.lit("void")))


@query("grounding_parse")
def grounding_parse(spark, sf):
    """Typical answers, and the conversations' whole texts, some with a tag at the end."""
    c = synth.table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ds = _pick(("pope", "vizwiz", "hallusionbench"), F.floor(F.col("id") / 3))
    tagged = F.concat("text", F.when(F.col("id") % 3 == 0, F.concat(F.lit("\n\nFINAL_ANSWER: "), _pick(ANSWERS, F.col("id")))).otherwise(""))
    rows = c.select("id", _pick(GROUNDED, F.col("id")).alias("x"), ds.alias("ds")).unionByName(c.select((F.col("id") + 1_000_000_000).alias("id"), tagged.alias("x"), ds.alias("ds")))
    return rows.withColumn("p", tx.parse_grounded(F.col("x"), F.col("ds"), F.lit(None).cast("string"))).select("id", "ds", "p.*")


def _distributions(spark, sf):
    """Per line of an order: log-probabilities and top tokens made from its numbers."""
    rows = synth.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (-F.col("l_tax") - 0.001).alias("a"), (-F.col("l_discount") - 0.002).alias("b"))
    p = F.exp("a") * 0.9
    return rows.withColumns({"logprobs": F.array("a", "b", F.col("a") + F.col("b")), "tops": F.array(F.create_map(F.lit("x"), p, F.lit("y"), 1 - p), F.create_map(F.lit("x"), F.exp("b"), F.lit("z"), F.lit(0.0)))})


@query("token_scores", """WITH r AS (SELECT l_orderkey, l_linenumber, -l_tax - 0.001::DOUBLE AS a, -l_discount - 0.002::DOUBLE AS b FROM lineitem), s AS (SELECT *, exp(a) * 0.9::DOUBLE AS p, exp(b) AS q FROM r)
SELECT l_orderkey, l_linenumber, round(least(1.0::DOUBLE, exp((a + b + (a + b)) / 3)), 9) AS confidence, round(a + b + (a + b), 9) AS logprob, round((-(p * ln(p) + (1 - p) * ln(1 - p)) - q * ln(q)) / 2, 9) AS entropy, round(((greatest(p, 1 - p) - least(p, 1 - p)) + q) / 2, 9) AS margin FROM s""")  # fmt: skip
def token_scores(spark, sf):
    d = _distributions(spark, sf)
    own = {"confidence": scores.confidence(F.col("logprobs")), "logprob": scores.answer_logprob(F.col("logprobs")), "entropy": scores.entropy(F.col("tops")), "margin": scores.margin(F.col("tops"))}
    return d.select("l_orderkey", "l_linenumber", *[F.round(x, 9).alias(n) for n, x in own.items()])


@query("answer_slice", "WITH l AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS v FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(v[greatest(1, len(v) - 2) : len(v)], ',') AS tail FROM l")
def answer_slice(spark, sf):
    rows = synth.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("v"))
    return rows.select("l_orderkey", F.array_join(F.transform(scores.last(F.col("v"), F.lit(3)), lambda x: x.cast("string")), ",").alias("tail"))


@query("semantic_match", """WITH r AS (SELECT event_id, event_type AS p, ['click', 'view', 'unknown', 'purchase'][event_id % 4 + 1] AS g, event_id % 3 = 0 AS closed, CASE WHEN event_id % 11 <> 0 THEN value / 200 END AS sim FROM events)
SELECT event_id, CASE WHEN p = g AND g <> 'unknown' THEN 1 WHEN closed OR g = 'unknown' THEN 0 WHEN sim IS NOT NULL THEN CAST(sim >= 0.82::DOUBLE AS INTEGER) ELSE -1 END AS matched FROM r""")  # fmt: skip
def semantic_match(spark, sf):
    n = F.col("event_id")
    m = scores.semantic_match(F.col("event_type"), _pick(("click", "view", "unknown", "purchase"), n), n % 3 == 0, F.when(n % 11 != 0, F.col("value") / 200))
    return synth.table(spark, sf, "events").select("event_id", F.coalesce(m, F.lit(-1)).alias("matched"))


@query("reference_match", """SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN 1 WHEN event_id % 2 = 0 THEN CAST(value / 200 >= 0.82::DOUBLE OR value / 400 >= 0.82::DOUBLE AS INTEGER) ELSE 0 END AS matched FROM events""")
def reference_match(spark, sf):
    m = scores.reference_match(F.col("event_type"), F.array(F.lit("click"), F.lit("error")), F.array(F.col("value") / 200, F.col("value") / 400), F.col("event_id") % 2 == 0)
    return synth.table(spark, sf, "events").select("event_id", m.cast("int").alias("matched"))


@query("alias_dedupe", "WITH g AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS kinds FROM g GROUP BY user_id")
def alias_dedupe(spark, sf):
    """Each user's kinds of events, once each, in the order in which they first came."""
    first = synth.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    rows = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("v"))  # of a closed set of kinds
    return rows.select("user_id", F.array_join("v.event_type", ",").alias("kinds"))


@query("ordered_digest", "SELECT conv_id, sha256(string_agg(role || ':' || coalesce(text, ''), '|' ORDER BY turn, role)) AS digest FROM conversations GROUP BY conv_id")
def ordered_digest(spark, sf):
    one = F.struct("turn", "role", F.concat("role", F.lit(":"), F.coalesce("text", F.lit(""))).alias("x"))
    rows = synth.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("v"))
    return rows.select("conv_id", F.sha2(F.array_join(F.transform("v", lambda s: s["x"]), "|"), 256).alias("digest"))


@query("canonical_hash", """SELECT event_id, sha256('{' || (SELECT string_agg('"' || k || '": ' || CAST(json_extract(props, '$."' || k || '"') AS VARCHAR), ', ' ORDER BY k) FROM (SELECT unnest(json_keys(props)) AS k)) || '}') AS digest FROM events""")
def canonical_hash(spark, sf):
    return synth.table(spark, sf, "events").select("event_id", h.canonical_json_sha256(F.col("props")).alias("digest"))


@query("json_props", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return synth.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("unit_hash", "SELECT o_orderkey, ('0x' || substr(sha256('42|' || CAST(o_orderkey AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM orders")
def unit_hash(spark, sf):
    return synth.table(spark, sf, "orders").select("o_orderkey", h.unit(h.joined(F.lit("42"), F.col("o_orderkey").cast("string"))).alias("u"))
