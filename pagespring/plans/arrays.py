"""Queries over tokens, logits and other arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions import vectors as vc
from ..operators import tensors as tz
from ..sources import tensors as tn
from ..sources.store import new_folder
from . import fixtures as fx

QUERIES: dict = {}
SQL: dict = {}

END = 151645
_T = f"t AS ({fx.TOKENS_SQL})"
_V = f"v AS ({fx.VECTORS_SQL})"


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _rounded(v, n: int = 6):
    """Each entry rounded; one that rounds to zero keeps its sign, as in IEEE 754 arithmetic
    (``round`` alone goes by decimals, which have no negative zero)."""

    def one(x):
        r = F.round(x, n)
        return F.when(r == 0, x * 0.0).otherwise(r)

    return F.transform(v, one)


@_query(f"WITH {_T}, e AS (SELECT page_id, tokens[i] AS token, confidences[i] AS c FROM t, unnest(range(1, len(tokens) + 1)) AS u(i)) SELECT page_id, round(coalesce(avg(c) FILTER (WHERE token <> {END}), 0), 4) AS confidence FROM e GROUP BY page_id")
def token_mean_confidence(spark, sf):
    """Mean confidence of the tokens that are not end tokens, 0 without any."""
    e = fx.table(spark, sf, "events").selectExpr("user_id AS page_id", f"{fx.TOKEN} AS token", "coalesce(value, 0D) AS c")
    mean = F.avg(F.when(F.col("token") != END, F.col("c")))
    return e.groupBy("page_id").agg(F.round(F.coalesce(mean, F.lit(0.0)), 4).alias("confidence"))


@_query(f"WITH {_T} SELECT page_id, list_filter(tokens, lambda x: x NOT IN ({END}, 5)) AS tokens FROM t")
def token_filter_special(spark, sf):
    return fx.tokens(spark, sf).select("page_id", tk.without(F.col("tokens"), [END, 5]).alias("tokens"))


@_query("SELECT page_id, list_concat(list_concat(CAST([151644, 8948, 151645, 198, 151644, 872, 198] AS BIGINT[]), list_transform(range(page_id % 9), lambda i: CAST(151655 AS BIGINT))), CAST([151645, 198, 151644, 77091, 198] AS BIGINT[])) AS ids FROM pages")
def token_prompt_assembly(spark, sf):
    p = fx.table(spark, sf, "pages")
    ids = tk.recogniser_prompt(F.col("page_id") % 9, [8948], [872, 198], [77091, 198], start=151644, end=END, newline=198, pad=151655)
    return p.select("page_id", ids.alias("ids"))


@_query(f"WITH {_T} SELECT page_id, CASE WHEN list_position(tokens, {END}) > 0 THEN tokens[1:list_position(tokens, {END})] ELSE tokens END AS tokens FROM t")
def token_take_until(spark, sf):
    return fx.tokens(spark, sf).select("page_id", tk.until(F.col("tokens"), END).alias("tokens"))


@_query(f"WITH {_T} SELECT page_id, tokens[greatest(len(tokens) - 63, 1):len(tokens)] AS tokens, len(tokens) >= 3 AND tokens[len(tokens) - 2:len(tokens)] = CAST([11, 7, 5] AS BIGINT[]) AS ended FROM t")
def token_tail_window(spark, sf):
    t = F.col("tokens")
    return fx.tokens(spark, sf).select("page_id", tk.tail(t).alias("tokens"), tk.ends_with(t, [11, 7, 5]).alias("ended"))


@_query(f"WITH {_V} SELECT page_id, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS token FROM v")
def greedy_argmax(spark, sf):
    return fx.vectors(spark, sf).select("page_id", vc.argmax(F.col("v")).alias("token"))


@_query(f"WITH {_V} SELECT page_id, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 9) AS p FROM v")
def greedy_topprob(spark, sf):
    return fx.vectors(spark, sf).select("page_id", F.round(vc.top_probability(F.col("v")), 9).alias("p"))


@_query(f"WITH {_V}, e AS (SELECT page_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM v) SELECT page_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p FROM e")
def softmax_rows(spark, sf):
    e = fx.vectors(spark, sf)
    return e.select("page_id", _rounded(vc.softmax(F.col("v"))).alias("p"))


@_query(f"WITH {_V} SELECT page_id, round(list_sum(v), 6) AS total, round(list_min(v), 6) AS least, round(list_max(v), 6) AS most, CAST(len(list_filter(v, lambda x: x <> 0)) AS INT) AS nonzero FROM v")
def vector_stats(spark, sf):
    v = F.col("v")
    return fx.vectors(spark, sf).select(
        "page_id", F.round(vc.total(v), 6).alias("total"), F.round(F.array_min(v), 6).alias("least"), F.round(F.array_max(v), 6).alias("most"), F.size(F.filter(v, lambda x: x != 0)).alias("nonzero")
    )


@_query("SELECT r_regionkey, CAST(i AS INT) AS i, CAST(j AS INT) AS j, NOT (j <= i + r_regionkey) AS masked FROM region, unnest(range(6)) AS a(i), unnest(range(CAST(6 + r_regionkey AS BIGINT))) AS b(j)")
def causal_mask(spark, sf):
    shapes = fx.table(spark, sf, "region").selectExpr("r_regionkey", "6 AS tgt", "r_regionkey AS offset")
    return tz.causal_mask(shapes)


@_query("SELECT r_regionkey, CAST(i AS INT) AS i, CAST(j AS INT) AS j, NOT (j <= i + r_regionkey AND i + r_regionkey - j <= 2) AS masked FROM region, unnest(range(6)) AS a(i), unnest(range(CAST(6 + r_regionkey AS BIGINT))) AS b(j)")
def causal_mask_sliding(spark, sf):
    shapes = fx.table(spark, sf, "region").selectExpr("r_regionkey", "6 AS tgt", "r_regionkey AS offset")
    return tz.causal_mask(shapes, sliding=2)


#: Sixteen rows make a sequence; a vector is its own query, key and value.
_SEQUENCE = "SELECT vec_id // 16 AS page_id, CAST(vec_id % 16 AS INT) AS pos, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"


def _attended(rows: str) -> str:
    """SQL: (page_id, pos, out) of causal attention over rows (page_id, pos, q, k, v)."""
    return (
        f"SELECT page_id, pos, list(y ORDER BY d) AS out FROM (SELECT page_id, pos, d, sum(p * v[d]) AS y FROM (SELECT page_id, pos, v, e / sum(e) OVER (PARTITION BY page_id, pos) AS p FROM"
        f" (SELECT page_id, pos, v, exp(score - max(score) OVER (PARTITION BY page_id, pos)) AS e FROM (SELECT a.page_id, a.pos, b.v, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.k[i])) / sqrt(len(a.q)) AS score"
        f" FROM {rows} a JOIN {rows} b ON a.page_id = b.page_id AND b.pos <= a.pos))), unnest(range(1, len(v) + 1)) AS u(d) GROUP BY page_id, pos, d) GROUP BY page_id, pos"
    )


def _sequence(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.selectExpr("vec_id DIV 16 AS page_id", "CAST(vec_id % 16 AS INT) AS pos", "transform(embedding, x -> CAST(x AS DOUBLE)) AS x")


@_query(f"WITH s AS ({_SEQUENCE}), r AS (SELECT page_id, pos, x AS q, x AS k, x AS v FROM s), o AS ({_attended('r')}) SELECT page_id, pos, list_transform(out, lambda x: round(x, 6)) AS out FROM o")
def attention_toy(spark, sf):
    rows = _sequence(spark, sf).selectExpr("page_id", "pos", "x AS q", "x AS k", "x AS v")
    return tz.attention(rows).select("page_id", "pos", _rounded(F.col("out")).alias("out"))


def _weight(i, j, seed: int):
    """Entry (i, j), both from 0, of a stand-in for a weight matrix, alike in Python and SQL."""
    return f"(((({i}) * 7 + ({j}) * 13 + {seed}) % 11 - 5) / 20.0)"


def _matrix(rows: int, columns: int, seed: int):
    return vc.matrix([[((i * 7 + j * 13 + seed) % 11 - 5) / 20.0 for j in range(columns)] for i in range(rows)])


def _sql_linear(v: str, rows: int, columns: int, seed: int) -> str:
    """SQL of the product of ``_matrix`` with a list."""
    w = _weight("i", "j - 1", seed) + "::DOUBLE"
    return f"list_transform(range({rows}), lambda i: list_sum(list_transform(range(1, {columns + 1}), lambda j: {v}[j] * {w})))"


def _sql_norm(v: str) -> str:
    return f"list_transform({v}, lambda t: t / sqrt(list_sum(list_transform({v}, lambda y: y * y)) / len({v}) + 0.00001::DOUBLE))"


@_query(f"WITH {_V} SELECT page_id, list_transform({_sql_linear('v', 8, 64, 1)}, lambda x: round(x, 6)) AS y FROM v")
def linear_rows(spark, sf):
    return fx.vectors(spark, sf).select("page_id", _rounded(vc.linear(F.col("v"), _matrix(8, 64, 1))).alias("y"))


@_query(f"WITH e AS (SELECT vec_id AS id, CAST(i - 1 AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)) SELECT id, CAST(j AS INT) AS j, round(sum(x * {_weight('j', 'i', 1)}), 6) AS y FROM e, unnest(range(8)) AS t(j) GROUP BY id, j")
def matmul_join(spark, sf):
    """The same product as a join with the weights' entries."""
    rows = fx.vectors(spark, sf).select(F.col("page_id").alias("id"), F.posexplode("v").alias("i", "x"))
    weights = spark.range(64).selectExpr("CAST(id AS INT) AS i", "explode(sequence(0, 7)) AS j").selectExpr("i", "j", f"CAST({_weight('j', 'i', 1)} AS DOUBLE) AS w")
    return tz.matmul(rows, weights).select("id", "j", F.round("y", 6).alias("y"))


@_query(f"WITH {_V} SELECT page_id, list_transform(v, lambda x: round(x / 2 * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715::DOUBLE * x * x * x))), 6)) AS g, list_transform(v, lambda x: round(x / (1 + exp(-x)), 6)) AS s FROM v")
def activations(spark, sf):
    return fx.vectors(spark, sf).select("page_id", _rounded(vc.gelu(F.col("v"))).alias("g"), _rounded(vc.silu(F.col("v"))).alias("s"))


def _sql_swiglu(v: str, size: int, inner: int, seed: int) -> str:
    gate, up = _sql_linear(v, inner, size, seed), _sql_linear(v, inner, size, seed + 1)
    return f"(SELECT {_sql_linear('m', size, inner, seed + 2)} FROM (SELECT list_transform(range(1, {inner + 1}), lambda z: g[z] / (1 + exp(-g[z])) * u[z]) AS m FROM (SELECT {gate} AS g, {up} AS u)))"


@_query(f"WITH {_V} SELECT page_id, list_transform({_sql_swiglu('v.v', 64, 6, 3)}, lambda x: round(x, 6)) AS y FROM v")
def swiglu_rows(spark, sf):
    y = vc.swiglu(F.col("v"), _matrix(6, 64, 3), _matrix(6, 64, 4), _matrix(64, 6, 5))
    return fx.vectors(spark, sf).select("page_id", _rounded(y).alias("y"))


def _sql_rotated(v: str, pos: str, size: int) -> str:
    half = size // 2
    angle = f"({pos} / pow(1000000.0::DOUBLE, (i - 1) * 2 / {float(size)}::DOUBLE))"
    return (
        f"list_concat(list_transform(range(1, {half + 1}), lambda i: {v}[i] * cos({angle}) - {v}[i + {half}] * sin({angle})),"
        f" list_transform(range(1, {half + 1}), lambda i: {v}[i + {half}] * cos({angle}) + {v}[i] * sin({angle})))"
    )


@_query(f"WITH s AS ({_SEQUENCE}) SELECT page_id, pos, list_transform({_sql_rotated('x', '(pos + 3)', 64)}, lambda x: round(x, 6)) AS q FROM s")
def rope_apply(spark, sf):
    table = tz.rope_table(spark.range(32).selectExpr("id AS pos"), 64)
    rows = _sequence(spark, sf).selectExpr("page_id", "pos", "x AS q")
    return tz.rotate(rows, table, ("q",), offset=3).select("page_id", "pos", _rounded(F.col("q")).alias("q"))


_LAYER = {name: seed for seed, name in enumerate(("q", "k", "v", "o", "gate", "up", "down"), 20)}


@_query(
    f"WITH s AS ({_SEQUENCE}), n AS (SELECT *, {_sql_norm('x')} AS n FROM s),"
    f" h AS (SELECT page_id, pos, {_sql_linear('n', 64, 64, 20)} AS q, {_sql_linear('n', 64, 64, 21)} AS k, {_sql_linear('n', 64, 64, 22)} AS v FROM n),"
    f" r AS (SELECT page_id, pos, {_sql_rotated('q', 'pos', 64)} AS q, {_sql_rotated('k', 'pos', 64)} AS k, v FROM h), a AS ({_attended('r')}),"
    f" b AS (SELECT s.page_id, s.pos, s.x, {_sql_linear('a.out', 64, 64, 23)} AS o FROM s JOIN a ON a.page_id = s.page_id AND a.pos = s.pos),"
    " c AS (SELECT page_id, pos, list_transform(range(1, 65), lambda z: x[z] + o[z]) AS h FROM b),"
    f" d AS (SELECT page_id, pos, h, {_sql_norm('h')} AS n FROM c),"
    f" g AS (SELECT page_id, pos, h, {_sql_linear('n', 6, 64, 24)} AS g, {_sql_linear('n', 6, 64, 25)} AS u FROM d),"
    " m AS (SELECT page_id, pos, h, list_transform(range(1, 7), lambda z: g[z] / (1 + exp(-g[z])) * u[z]) AS m FROM g),"
    f" y AS (SELECT page_id, pos, h, {_sql_linear('m', 64, 6, 26)} AS y FROM m)"
    " SELECT page_id, pos, list_transform(range(1, 65), lambda z: round(h[z] + y[z], 4)) AS x FROM y"
)
def decoder_layer(spark, sf):
    shapes = {"gate": (6, 64), "up": (6, 64), "down": (64, 6)}
    weights = {name: _matrix(*shapes.get(name, (64, 64)), seed) for name, seed in _LAYER.items()}
    weights["rope"] = tz.rope_table(spark.range(16).selectExpr("id AS pos"), 64)
    return tz.decoder_layer(_sequence(spark, sf), weights).select("page_id", "pos", _rounded(F.col("x"), 4).alias("x"))


@_query(
    "WITH p AS (SELECT vec_id // 100 AS page_id, vec_id % 100 // 10 AS py, vec_id % 10 AS px, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),"
    f" n AS (SELECT page_id, py, px, {_sql_norm('v')} AS v FROM p), e AS (SELECT page_id, py, px, CAST(i - 1 AS BIGINT) AS h, v[i] AS x FROM n, unnest(range(1, len(v) + 1)) AS u(i)),"
    " m AS (SELECT page_id, py // 2 AS py, px // 2 AS px, list(x ORDER BY h * 4 + py % 2 * 2 + px % 2) AS m FROM e GROUP BY page_id, py // 2, px // 2),"
    f" a AS (SELECT page_id, py, px, {_sql_linear('m', 8, 256, 30)} AS a FROM m), b AS (SELECT page_id, py, px, {_sql_linear('a', 8, 8, 31)} AS b FROM a),"
    " c AS (SELECT page_id, py, px, list_transform(b, lambda x: x / 2 * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715::DOUBLE * x * x * x)))) AS c FROM b)"
    f" SELECT page_id, py, px, list_transform({_sql_linear('c', 4, 8, 32)}, lambda x: round(x, 5)) AS out FROM c"
)
def projector(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    p = e.selectExpr("vec_id DIV 100 AS page_id", "vec_id % 100 DIV 10 AS py", "vec_id % 10 AS px", "transform(embedding, x -> CAST(x AS DOUBLE)) AS v")
    return tz.projector(p, _matrix(8, 256, 30), _matrix(8, 8, 31), _matrix(4, 8, 32)).withColumn("out", _rounded(F.col("out"), 5))


@_query(f"WITH {_V}, o AS (SELECT *, page_id // 8 AS batch FROM v) SELECT batch, list(page_id ORDER BY page_id) AS ids, CAST(count(*) AS INT) AS n, list_transform(flatten(list(v ORDER BY page_id)), lambda x: round(x, 6)) AS data FROM o GROUP BY batch")
def batch_stack(spark, sf):
    images = fx.vectors(spark, sf).selectExpr("page_id AS id", "page_id AS pos", "v AS data")
    return tz.stacked(images, 8).withColumn("data", _rounded(F.col("data")))


@_query(f"WITH {_T} SELECT page_id, tokens[-1] AS token FROM t")
def last_position(spark, sf):
    return fx.tokens(spark, sf).select("page_id", tk.last(F.col("tokens")).alias("token"))


@_query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS token FROM customer")
def vocab_lookup(spark, sf):
    """Words to their ids by a map; a word that it lacks would be an error."""
    names = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    vocabulary = F.create_map(*[x for i, w in enumerate(names) for x in (F.lit(w), F.lit(i))])
    return fx.table(spark, sf, "customer").select("c_custkey", tk.looked_up(vocabulary, F.col("c_mktsegment")).alias("token"))


@_query(
    "WITH RECURSIVE s AS (SELECT doc_id, [doc_id % 16, doc_id // 16 % 16] AS tokens, 0 AS k FROM documents"
    " UNION ALL SELECT doc_id, CASE WHEN k > 0 AND tokens[-1] = 9 THEN tokens ELSE list_append(tokens, (SELECT CAST(min_by(j, (-x, j)) AS BIGINT) FROM (SELECT j, CASE WHEN k > 0 AND j IN (0, 4) THEN CAST('-inf' AS DOUBLE)"
    " WHEN list_contains(tokens[-4:], j) THEN CASE WHEN w >= 0 THEN w / 1.1::DOUBLE ELSE w * 1.1::DOUBLE END ELSE w END AS x FROM (SELECT j, ((tokens[-1] * tokens[-1] + j * j + tokens[-1] * j * 7 + 3) % 23 - 8) / 2.0::DOUBLE AS w FROM unnest(range(16)) AS u(j))))) END, k + 1 FROM s WHERE k < 12)"
    " SELECT doc_id, tokens FROM s WHERE k = 12"
)
def greedy_decode(spark, sf):
    """Greedy decoding from recorded logits: stop rule, token limit, barred ids, repeat penalty."""
    logits = vc.matrix([[((t * t + j * j + t * j * 7 + 3) % 23 - 8) / 2.0 for j in range(16)] for t in range(16)])
    start = F.expr("array(doc_id % 16, doc_id DIV 16 % 16)")
    return fx.table(spark, sf, "documents").select("doc_id", tk.greedy(start, logits, limit=12, end=9, window=4, barred=(0, 4)).alias("tokens"))


@_query("SELECT l.l_orderkey AS page_id, l.l_linenumber AS pos, n.n_nationkey AS token, n.n_name AS emb FROM lineitem l JOIN nation n ON n.n_nationkey = CAST(l.l_partkey % 25 AS INT)")
def embed_lookup(spark, sf):
    """Token rows to their vocabulary entry; Spark broadcasts the vocabulary by its size."""
    rows = fx.table(spark, sf, "lineitem").selectExpr("l_orderkey AS page_id", "l_linenumber AS pos", "CAST(l_partkey % 25 AS INT) AS token")
    vocabulary = fx.table(spark, sf, "nation").selectExpr("n_nationkey AS token", "n_name AS emb")
    return rows.join(vocabulary, "token").select("page_id", "pos", "token", "emb")


_SPL = (
    "t AS (SELECT user_id AS page_id, event_id AS pos, CASE WHEN event_type = 'view' THEN 9 ELSE 1 END AS token, 'tok' || CAST(event_id AS STRING) AS emb FROM events),"
    " i AS (SELECT user_id AS page_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, 'img' || CAST(event_id AS STRING) AS image_emb FROM events WHERE event_type = 'view')"
)


@_query(f"WITH {_SPL}, n AS (SELECT *, CASE WHEN token = 9 THEN sum(CASE WHEN token = 9 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) - 1 END AS k FROM t) SELECT n.page_id, n.pos, CAST(n.token AS INT) AS token, coalesce(i.image_emb, n.emb) AS emb FROM n LEFT JOIN i ON i.page_id = n.page_id AND i.k = n.k")
def splice_positions(spark, sf):
    from pyspark.sql import Window

    e = fx.table(spark, sf, "events")
    tokens = e.selectExpr("user_id AS page_id", "event_id AS pos", "CASE WHEN event_type = 'view' THEN 9 ELSE 1 END AS token", "concat('tok', CAST(event_id AS STRING)) AS emb")
    w = Window.partitionBy("user_id").orderBy("event_id")
    images = e.where("event_type = 'view'").select(
        F.col("user_id").alias("page_id"), (F.row_number().over(w) - 1).cast("bigint").alias("k"), F.concat(F.lit("img"), F.col("event_id").cast("string")).alias("image_emb")
    )
    return tz.splice_positions(tokens, images, 9)


@_query("SELECT n_regionkey AS page_id, n_nationkey * 4 + CAST(r AS INT) AS head, n_name FROM nation, unnest(range(4)) AS u(r)")
def repeat_heads(spark, sf):
    heads = fx.table(spark, sf, "nation").selectExpr("n_regionkey AS page_id", "n_nationkey AS head", "n_name")
    return tz.repeat_heads(heads, 4)


@_query(f"WITH {_V} SELECT page_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y)) / len(v) + 0.00001::DOUBLE), 6)) AS v FROM v")
def rms_norm(spark, sf):
    return fx.vectors(spark, sf).select("page_id", _rounded(vc.rms_norm(F.col("v"))).alias("v"))


@_query(
    "WITH p AS (SELECT vec_id // 100 AS page_id, vec_id % 100 // 10 AS py, vec_id % 10 AS px, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT page_id, py, px, CAST(i - 1 AS BIGINT) AS h, v[i] AS x FROM p, unnest(range(1, len(v) + 1)) AS u(i))"
    " SELECT page_id, py // 2 AS py, px // 2 AS px, list(round(x, 6) ORDER BY h * 4 + py % 2 * 2 + px % 2) AS merged FROM e GROUP BY page_id, py // 2, px // 2"
)
def patch_merge(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    p = e.selectExpr("vec_id DIV 100 AS page_id", "vec_id % 100 DIV 10 AS py", "vec_id % 10 AS px", "transform(embedding, x -> CAST(x AS DOUBLE)) AS v")
    return tz.patch_merge(p).withColumn("merged", _rounded(F.col("merged")))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS pos, CAST(i AS INT) AS i, round(cos(n_nationkey / pow(1000000.0::DOUBLE, i / 16.0::DOUBLE)), 9) AS cos, round(sin(n_nationkey / pow(1000000.0::DOUBLE, i / 16.0::DOUBLE)), 9) AS sin FROM nation, unnest(range(0, 16, 2)) AS u(i)")
def rope_table(spark, sf):
    positions = fx.table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS pos")
    t = tz.rope_table(positions, 16)
    return t.select("pos", "i", F.round("cos", 9).alias("cos"), F.round("sin", 9).alias("sin"))


@_query(f"WITH {_V}, m AS (SELECT page_id, list_transform(range(1, len(v) + 1), lambda i: CASE WHEN i - 1 IN (0, 3, 17) THEN CAST('-inf' AS DOUBLE) ELSE v[i] END) AS v FROM v) SELECT page_id, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS token, CAST(len(list_filter(v, lambda x: x = CAST('-inf' AS DOUBLE))) AS INT) AS barred FROM m")
def logit_mask(spark, sf):
    e = fx.vectors(spark, sf).select("page_id", vc.masked(F.col("v"), [0, 3, 17]).alias("v"))
    return e.select("page_id", vc.argmax(F.col("v")).alias("token"), F.size(F.filter("v", lambda x: x == float("-inf"))).alias("barred"))


@_query(f"WITH {_V}, r AS (SELECT page_id, v, [page_id % 64, page_id * 7 % 64, page_id % 64] AS recent FROM v) SELECT page_id, list_transform(range(1, len(v) + 1), lambda i: round(CASE WHEN list_contains(recent, i - 1) THEN CASE WHEN v[i] >= 0 THEN v[i] / 1.1::DOUBLE ELSE v[i] * 1.1::DOUBLE END ELSE v[i] END, 6)) AS v FROM r")
def repeat_penalty(spark, sf):
    e = fx.vectors(spark, sf).withColumn("recent", F.expr("array(page_id % 64, page_id * 7 % 64, page_id % 64)"))
    return e.select("page_id", _rounded(vc.repeat_penalised(F.col("v"), F.col("recent"))).alias("v"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_config(spark, sf):
    """Typed parse of JSON text by an explicit schema."""
    e = fx.table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k bigint", {"mode": "FAILFAST"}).alias("c")).select("event_id", "c.k")


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props, '$.k') IS NOT NULL AS has FROM events")
def json_open_value(spark, sf):
    """JSON text as an open value, read without a schema."""
    v = fx.table(spark, sf, "events").select("event_id", F.parse_json("props").alias("v"))
    return v.select("event_id", F.try_variant_get("v", "$.k", "string").alias("k"), F.try_variant_get("v", "$.k", "variant").isNotNull().alias("has"))


@_query("SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL")
def tensor_round_trip(spark, sf):
    """Vectors written as tensors, one file a partition, and read back by ranges of their bytes."""
    rows = fx.vectors(spark, sf).where("page_id is not null and v is not null").select(F.col("page_id").alias("id"), "v")
    folder = new_folder(spark)
    tn.write_vectors(rows, folder).agg(F.sum("rows")).collect()
    ids = tn.vectors(spark, folder, "ids").select("file", "row", F.col("v")[0].cast("bigint").alias("id"))
    return tn.vectors(spark, folder, "v").join(ids, ["file", "row"]).select("id", "v")
