"""The queries over the driver's tables and their SQL.

The tables stand in for those of a code graph: customers are modules, nations libraries, orders functions and pairs of a part
and a supplier external calls; see each query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import align, code_graph, datasets, encode, graph, metrics, mixing, templates


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")




def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call (part, supplier) pairs, are in customers; customers import nations."""
    c, o, i = (_t(spark, sf_dir, x) for x in ("customer", "orders", "lineitem"))
    imports = c.select(F.concat(F.lit("c:"), "c_custkey").alias("src"), F.concat(F.lit("n:"), "c_nationkey").alias("dst"), F.lit("IMPORTS").alias("etype"))
    inside = o.select(F.concat(F.lit("o:"), "o_orderkey").alias("src"), F.concat(F.lit("c:"), "o_custkey").alias("dst"), F.lit("IN_MODULE").alias("etype"))
    calls = i.select(F.concat(F.lit("o:"), "l_orderkey").alias("src"), F.concat(F.lit("e:"), "l_partkey", F.lit(":"), "l_suppkey").alias("dst"), F.lit("CALLS").alias("etype"))
    return imports.union(inside).union(calls)


_EDGES_SQL = """(SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, 'IMPORTS' AS etype FROM customer
UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'IN_MODULE' FROM orders
UNION ALL SELECT 'o:' || l_orderkey, 'e:' || l_partkey || ':' || l_suppkey, 'CALLS' FROM lineitem)"""


def qa_pattern1_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, o, i = (_t(spark, sf_dir, x) for x in ("nation", "customer", "orders", "lineitem"))
    modules = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    left = o.join(modules, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("mid"), F.col("n_name").alias("library"))
    right = i.select(F.col("l_orderkey").alias("mid"), "l_partkey", "l_suppkey", F.col("l_orderkey").alias("answer"))
    found = graph.unique_hops(left, right, ["library", "l_partkey", "l_suppkey"])
    return found.select("library", F.concat_ws(":", "l_partkey", "l_suppkey").alias("external"), "answer")


def qa_pattern2_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (tests) of orders (functions) of a pair (external)."""
    o, i = (_t(spark, sf_dir, x) for x in ("orders", "lineitem"))
    left = o.select(F.col("o_orderkey").alias("mid"), F.col("o_custkey").alias("answer"))
    right = i.select(F.col("l_orderkey").alias("mid"), "l_partkey", "l_suppkey")
    found = graph.unique_hops(left, right, ["l_partkey", "l_suppkey"])
    return found.select(F.concat_ws(":", "l_partkey", "l_suppkey").alias("external"), "answer")


def kg_nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _edges(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    kind = F.element_at(F.create_map(*[F.lit(x) for p in {"c": "Module", "n": "Library", "o": "Function", "e": "ExternalAPI"}.items() for x in p]), F.substring("id", 1, 1))
    return ends.groupBy(kind.alias("node_type")).agg(F.count(F.lit(1)).alias("n"))


def kg_two_hop_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, nations and regions."""
    s, n = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation")
    a = s.select(F.concat(F.lit("s:"), "s_suppkey").alias("src"), F.concat(F.lit("n:"), "s_nationkey").alias("dst"))
    b = n.select(F.concat(F.lit("n:"), "n_nationkey").alias("src"), F.concat(F.lit("r:"), "n_regionkey").alias("dst"))
    return code_graph.neighbours(a.union(b))


def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items call brands; the last part of a brand, by size and key, is what a name means; large sizes are unknown."""
    i, p = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    called = i.join(p.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    callers = called.select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("line"), F.col("p_type").alias("module"), F.col("p_brand").alias("callee"))
    functions = p.where("p_size <= 25").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_type").alias("module"), F.col("p_brand").alias("name"), F.struct("p_size", "p_partkey").alias("order"))
    return code_graph.resolve_calls(callers, functions).select("src", "line", "dst")


def call_chain_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order calls the customer's next one; chains of two to five orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = _t(spark, sf_dir, "orders").withColumn("dst", F.lead("o_orderkey").over(w)).where("dst IS NOT NULL")
    links = links.select(F.col("o_orderkey").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(0).alias("ord"))
    chains = code_graph.unique_chains(links, 5).where("size(chain) > 1")
    return chains.select("start", F.element_at("chain", -1).alias("last"), F.size("chain").cast("long").alias("n"))


def _order_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, i, s, n = (_t(spark, sf_dir, x) for x in ("customer", "orders", "lineitem", "supplier", "nation"))
    own = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_module"), F.col("n_regionkey").alias("c_region"))
    other = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("t_module"), F.col("n_regionkey").alias("t_region"))
    rows = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c.join(own, "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.join(other, "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("o_orderkey", "c_module", "c_region", "t_module", "t_region")


def _suffix_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(".", F.lit("world"), "r_name", "n_name").alias("name"), "n_name", "r_name")


def module_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _suffix_modules(spark, sf_dir)
    suffixes = m.select("name", F.explode(code_graph.dotted_suffixes(F.col("name"))).alias("suffix"))
    libs = m.select(F.concat_ws(".", "r_name", "n_name").alias("library")).union(m.select("n_name"))
    return libs.join(suffixes, F.col("library") == F.col("suffix")).select("library", F.col("name").alias("module"))


def best_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers import their nation's name; modules of that name stand below two worlds."""
    m = _suffix_modules(spark, sf_dir)
    modules = m.select("name").union(m.select(F.concat_ws(".", F.lit("old"), "n_name").alias("name")))
    s, n = _t(spark, sf_dir, "supplier"), m
    importers = s.join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(n.select("n_name", "r_name"), "n_name")
    importers = importers.select(F.concat(F.lit("world."), "r_name", F.lit(".s"), "s_suppkey").alias("importer"), F.col("n_name").alias("library"))
    return code_graph.resolve_libraries(importers, modules)


SHAREGPT = align.DatasetAttr(formatting="sharegpt", messages="messages", user_tag="user", assistant_tag="assistant")
OPENAI = align.dataset_attr({"formatting": "openai", "columns": {"messages": "messages"}, "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant", "observation_tag": "tool", "function_tag": "function", "system_tag": "system"}})


def _shown(rows: DataFrame) -> DataFrame:
    """Aligned rows as flat columns."""
    joined = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return rows.select(joined("_prompt").alias("prompt"), joined("_response").alias("response"), F.coalesce("_system", F.lit("")).alias("system"))


def sharegpt_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.conversations(_t(spark, sf_dir, "conversations"), "from", "value").drop("conv_id")
    return _shown(align.align_dataset(rows, SHAREGPT))


def openai_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(align.align_dataset(datasets.conversations(_t(spark, sf_dir, "conversations")).drop("conv_id"), OPENAI))


def alpaca_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select(F.md5("text").alias("instruction"), F.col("source").alias("input"), F.col("lang").alias("output"))
    return _shown(align.align_dataset(rows, align.DatasetAttr()))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")


def kto_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select(F.col("source").alias("instruction"), F.md5("text").alias("output"), (F.col("quality") == 1).alias("good"))
    attr = align.dataset_attr({"columns": {"prompt": "instruction", "response": "output", "kto_tag": "good"}})
    return _shown(align.align_dataset(rows, attr)).drop("system")


def kto_kl_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode.batch_numbers(_t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("response")), "doc_id", 300)
    return encode.shift_within_batch(rows, "response", "kl_response").select("doc_id", F.col("batch").cast("long").alias("batch"), "kl_response")


def chatml_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = datasets.conversations(_t(spark, sf_dir, "conversations"))
    lead = F.coalesce(F.get("messages", F.lit(0))["role"] == "system", F.lit(False))
    chats = chats.select("conv_id", F.when(lead, F.get("messages", F.lit(0))["content"]).otherwise("").alias("system"), F.filter("messages", lambda m: m["role"] != "system").alias("messages"))
    return chats.select("conv_id", templates.render(F.col("messages"), templates.get_template("chatml"), F.col("system")).alias("rendered"))


def infer_seqlen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = datasets.turn_pairs(_t(spark, sf_dir, "conversations")).withColumns({"s": F.length("prompt"), "t": F.length("response")})
    n, m = tx.infer_seqlen(F.col("s"), F.col("t"), 150)
    return pairs.select("conv_id", "turn", n.cast("long").alias("source_len"), m.cast("long").alias("target_len"))


def _word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a token for each blank-separated piece, its length."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    return encode.batch_numbers(rows, "doc_id", 100)


def pretrain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode.pretrain_blocks(_word_lengths(spark, sf_dir), "ids", 128, 0)
    return out.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("input_ids")).alias("tokens"))


def sft_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _word_lengths(spark, sf_dir).select(F.col("batch").cast("long").alias("batch"), "rn", F.col("ids").alias("input_ids"), F.col("ids").alias("labels"))
    out = encode.pack_sft(rows, 2048, neat=True)
    return out.select("batch", "pack", F.size("input_ids").alias("length"), F.array_max("attention_mask").alias("parts"))


def pad_collate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _word_lengths(spark, sf_dir).withColumn("batch", F.floor(F.col("rn") / 8)).select("batch", F.col("ids").alias("input_ids"), F.col("ids").alias("labels"))
    padded = encode.pad_batch(rows, 8, input_ids=0, labels=-100)
    return padded.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.sum(F.size("labels")).alias("padded"), F.sum(F.size(F.filter("labels", lambda x: x != -100))).alias("valid"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.split_train(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def sample_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    return mixing.sample_to(docs, "doc_id", n + n // 2).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows: a user's run, the event's number as step, its value as loss."""
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("current_steps"), F.col("value").alias("loss"), F.col("event_type").alias("kind"))


def ema_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ema(_log(spark, sf_dir), "run", "current_steps", "loss").select("run", "current_steps", F.round("smoothed", 6).alias("smoothed"))


def latest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy("run").agg(F.max_by(F.struct("current_steps", "loss"), "current_steps").alias("r")).select("run", "r.*")


def running_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).withColumn("window", F.floor(F.col("current_steps") / 50).cast("long"))
    return metrics.running_meter(rows, F.col("loss"), F.pmod("current_steps", F.lit(7)) + 1, "window").select("window", F.round("mean", 6).alias("mean"))


def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_id", F.pmod("event_id", F.lit(1000)).alias("done"), F.lit(1000).alias("total"), (F.pmod("event_id", F.lit(977)) * 13.0).alias("seconds"))
    return metrics.progress(rows, "done", "total", "seconds").select("event_id", "percentage", "elapsed_time")


def benchmark_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _t(spark, sf_dir, "events").select(F.concat(F.lit("m"), F.pmod("user_id", F.lit(3))).alias("model"), F.col("event_type").alias("benchmark"), "value")
    wide = metrics.compare_models(scores.groupBy("model", "benchmark").agg((F.round(F.avg("value")) / 1000).alias("value")), ["m0", "m1", "m9"])
    return wide


def preference_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    means = rows.groupBy("source").agg(F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))).alias("chosen"), F.avg(F.when(F.col("quality") == 0, F.col("n_chars"))).alias("rejected"))
    return metrics.preference_accuracy(means, "chosen", "rejected").select(F.round("accuracy", 6).alias("accuracy"))


def feedback_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("good", F.col("quality") == 1)
    out = metrics.feedback_metrics(rows, "n_chars", "good")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


def bleu_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _t(spark, sf_dir, "benchmark").join(_t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prediction")), F.col("item_id") == F.col("doc_id"))
    return pairs.select("item_id", metrics.text_similarity(F.col("prediction"), F.col("text")).alias("s")).select("item_id", "s.*")


def valid_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _word_lengths(spark, sf_dir).withColumn("batch", F.floor(F.col("rn") / 16)).withColumn("labels", F.transform("ids", lambda x: F.when(x > 5, x).otherwise(-100)))
    out = metrics.valid_token_ratio(rows)
    return out.select("valid", "total", F.round("ratio", 9).alias("ratio"), F.round(metrics.learning_rate(2048, 16, F.col("ratio")), 12).alias("lr"))


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return datasets.dedup_first(rows, ["text"], "doc_id")


def _lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "lang")


QUERIES = {
    "qa_pattern1_unique": qa_pattern1_unique,
    "qa_pattern2_unique": qa_pattern2_unique,
    "kg_nodes_by_type": kg_nodes_by_type,
    "kg_edges_by_type": lambda s, d: graph.edges_by_type(_edges(s, d)),
    "kg_edge_coalesce": lambda s, d: graph.coalesce_edges(_edges(s, d)),
    "kg_two_hop_neighbours": kg_two_hop_neighbours,
    "call_resolution": call_resolution,
    "call_chain_unique": call_chain_unique,
    "cross_module_unique": lambda s, d: code_graph.single(_order_nations(s, d).where("t_module <> c_module"), "t_module", "o_orderkey"),
    "import_prefix_unique": lambda s, d: code_graph.single(_order_nations(s, d).where("t_region = c_region"), "t_module", "o_orderkey", "c_region"),
    "module_suffix_match": module_suffix_match,
    "best_prefix_match": best_prefix_match,
    "sharegpt_align_valid": lambda s, d: datasets.valid_conversations(_t(s, d, "conversations")),
    "sharegpt_turn_pairs": lambda s, d: datasets.turn_pairs(_t(s, d, "conversations")),
    "sharegpt_align": sharegpt_align,
    "openai_align": openai_align,
    "alpaca_align": alpaca_align,
    "kto_pairs": kto_pairs,
    "kto_kl_shift": kto_kl_shift,
    "chatml_render": chatml_render,
    "infer_seqlen_pairs": infer_seqlen_pairs,
    "pretrain_blocks": pretrain_blocks,
    "sft_pack": sft_pack,
    "pad_collate_stats": pad_collate_stats,
    "valid_token_ratio": valid_token_ratio,
    "qa_dedup_first": dedup_first,
    "length_cdf": lambda s, d: datasets.length_histogram(_t(s, d, "documents"), 1000),
    "kept_ratio": lambda s, d: metrics.kept_ratio(_labelled(s, d).withColumn("kept", F.col("quality") == 1), "kept", "lang", "source"),
    "category_accuracy": lambda s, d: metrics.category_accuracy(_labelled(s, d).withColumn("right", F.col("quality") != F.col("toxic")), "lang", "right"),
    "mix_concat": lambda s, d: mixing.concat([_lang(s, d).where(F.col("lang") == x) for x in ("en", "de")]),
    "mix_interleave_under": lambda s, d: mixing.interleave(_lang(s, d), "lang", "doc_id", "first"),
    "mix_interleave_over": lambda s, d: mixing.interleave(_lang(s, d), "lang", "doc_id", "last"),
    "split_counts": split_counts,
    "sample_with_replacement": sample_with_replacement,
    "tag_extract": lambda s, d: _t(s, d, "pages").select("page_id", tx.tag(F.col("html"), "title").alias("title")),
    "answer_extract": lambda s, d: _t(s, d, "documents").select("doc_id", tx.extract_answer(F.col("text")).alias("answer")),
    "answer_normalize": lambda s, d: _t(s, d, "part").select("p_partkey", tx.normalize_answer(F.concat(F.lit(" $\\text{"), "p_name", F.lit("}$ \n"))).alias("answer")),
    "ema_smooth": ema_smooth,
    "latest_log": latest_log,
    "running_meter": running_meter,
    "progress_eta": progress_eta,
    "benchmark_compare": benchmark_compare,
    "preference_accuracy": preference_accuracy,
    "feedback_rewards": feedback_rewards,
    "bleu_rouge": bleu_rouge,
    "json_props_extract": lambda s, d: _t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
}

_NATIONS_SQL = """(SELECT o_orderkey, cn.n_name AS c_module, cn.n_regionkey AS c_region, sn.n_name AS t_module, sn.n_regionkey AS t_region FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)"""
_RN_SQL = "row_number() OVER (ORDER BY doc_id) - 1"
_CHAT_SQL = """t AS (SELECT conv_id, turn, role, text, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations),
s AS (SELECT conv_id, max(CASE WHEN turn = t0 AND role = 'system' THEN text END) AS system FROM t GROUP BY conv_id),
m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE NOT (turn = t0 AND role = 'system')),
v AS (SELECT conv_id, bool_and(role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END) AND count(*) % 2 = 0 AS ok FROM m GROUP BY conv_id)"""
_ALIGN_SQL = f"""WITH {_CHAT_SQL}
SELECT coalesce(string_agg(CASE WHEN ok AND i < n THEN role || ':' || text END, '|' ORDER BY i), '') AS prompt,
coalesce(string_agg(CASE WHEN ok AND i = n THEN role || ':' || text END, '|' ORDER BY i), '') AS response, SYSTEM AS system
FROM s LEFT JOIN m USING (conv_id) LEFT JOIN v USING (conv_id) GROUP BY conv_id"""
_PIECES_SQL = f"(SELECT doc_id, len(string_split(text, ' ')) AS n, [length(x) FOR x IN string_split(text, ' ')] AS ids, {_RN_SQL} AS rn FROM documents)"
_LABELLED_SQL = "documents JOIN labels USING (doc_id)"
_PARTS_SQL = """p AS (SELECT lang, count(*) AS size, row_number() OVER (ORDER BY lang) - 1 AS place FROM documents GROUP BY lang),
b AS (SELECT min(size) AS lo, max(size) AS hi, count(*) AS k FROM p),
r AS (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS rank FROM documents)"""

ORACLES = {
    "qa_pattern1_unique": """WITH l AS (SELECT DISTINCT o_orderkey, n_name AS library FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT DISTINCT l_orderkey, l_partkey || ':' || l_suppkey AS external FROM lineitem)
SELECT library, external, min(o_orderkey) AS answer FROM l JOIN c ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) = 1""",
    "qa_pattern2_unique": """WITH c AS (SELECT DISTINCT l_orderkey, l_partkey || ':' || l_suppkey AS external FROM lineitem)
SELECT external, min(o_custkey) AS answer FROM orders JOIN c ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) = 1""",
    "kg_nodes_by_type": f"""SELECT CASE substr(id, 1, 1) WHEN 'c' THEN 'Module' WHEN 'n' THEN 'Library' WHEN 'o' THEN 'Function' ELSE 'ExternalAPI' END AS node_type, count(*) AS n
FROM (SELECT src AS id FROM {_EDGES_SQL} UNION SELECT dst FROM {_EDGES_SQL}) GROUP BY 1""",
    "kg_edges_by_type": f"SELECT etype, count(*) AS n FROM (SELECT DISTINCT * FROM {_EDGES_SQL}) GROUP BY etype",
    "kg_edge_coalesce": f"SELECT src, dst, string_agg(DISTINCT etype, ',' ORDER BY etype) AS etypes FROM {_EDGES_SQL} GROUP BY src, dst",
    "kg_two_hop_neighbours": """WITH e AS (SELECT 's:' || s_suppkey AS a, 'n:' || s_nationkey AS b FROM supplier UNION SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), h AS (SELECT a AS node, b AS neighbour, 1 AS distance FROM u UNION ALL SELECT x.a, y.b, 2 FROM u x JOIN u y ON x.b = y.a WHERE x.a <> y.b)
SELECT node, neighbour, CAST(min(distance) AS INTEGER) AS distance FROM h GROUP BY 1, 2""",
    "call_resolution": """WITH f AS (SELECT p_type, p_brand, arg_max(p_partkey, p_size::BIGINT * 1000000000 + p_partkey) AS k FROM part WHERE p_size <= 25 GROUP BY 1, 2)
SELECT l_orderkey AS src, l_linenumber AS line, coalesce('part:' || f.k, 'ext:' || p.p_brand) AS dst FROM lineitem JOIN part p ON l_partkey = p.p_partkey LEFT JOIN f ON f.p_type = p.p_type AND f.p_brand = p.p_brand""",
    "call_chain_unique": """WITH r AS (SELECT o_orderkey, row_number() OVER w AS k, first_value(o_orderkey) OVER w AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))
SELECT CAST(o_orderkey AS VARCHAR) AS start, CAST(last AS VARCHAR) AS last, k AS n FROM r WHERE k BETWEEN 2 AND 5""",
    "cross_module_unique": f"SELECT o_orderkey, min(t_module) AS t_module FROM {_NATIONS_SQL} WHERE t_module <> c_module GROUP BY 1 HAVING count(DISTINCT t_module) = 1",
    "import_prefix_unique": f"SELECT o_orderkey, c_region, min(t_module) AS t_module FROM {_NATIONS_SQL} WHERE t_region = c_region GROUP BY 1, 2 HAVING count(DISTINCT t_module) = 1",
    "module_suffix_match": """WITH m AS (SELECT 'world.' || r_name || '.' || n_name AS module, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name || '.' || n_name AS library, module FROM m UNION ALL SELECT n_name, module FROM m""",
    "best_prefix_match": """SELECT 'world.' || r_name || '.s' || s_suppkey AS importer, n_name AS library, 'world.' || r_name || '.' || n_name AS module
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "sharegpt_align_valid": """WITH f AS (SELECT conv_id, min(turn) AS t0, arg_min(role, turn) AS r0 FROM conversations GROUP BY conv_id),
r AS (SELECT c.conv_id, role, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS i FROM conversations c JOIN f ON c.conv_id = f.conv_id AND NOT (r0 = 'system' AND turn = t0))
SELECT conv_id, count(*) AS n_turns, count(*) % 2 = 0 AND bool_and(role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END) AS valid FROM r GROUP BY conv_id""",
    "sharegpt_turn_pairs": """SELECT conv_id, turn, prompt, text AS response FROM (SELECT *, lag(text) OVER w AS prompt, lag(role) OVER w AS before
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND before = 'user'""",
    "sharegpt_align": _ALIGN_SQL.replace("SYSTEM", "coalesce(max(system), '')"),
    "openai_align": _ALIGN_SQL.replace("SYSTEM", "coalesce(max(system) || chr(10) || 'detailed thinking off', 'detailed thinking off')"),
    "alpaca_align": "SELECT 'user:' || md5(text) || chr(10) || source AS prompt, 'assistant:' || lang AS response, '' AS system FROM documents",
    "kto_pairs": f"SELECT 'user:' || source AS prompt, CASE WHEN quality = 1 THEN 'assistant:' || md5(text) || '|assistant:' ELSE 'assistant:|assistant:' || md5(text) END AS response FROM {_LABELLED_SQL}",
    "kto_kl_shift": f"""WITH d AS (SELECT doc_id, md5(text) AS r, ({_RN_SQL}) // 300 AS batch FROM documents)
SELECT doc_id, CAST(batch AS BIGINT) AS batch, coalesce(lag(r) OVER (PARTITION BY batch ORDER BY doc_id), last_value(r) OVER (PARTITION BY batch ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS kl_response FROM d""",
    "chatml_render": """SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '<|im_start|>system' || chr(10) || text || '<|im_end|>' || chr(10)
WHEN 'user' THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE text || '<|im_end|>' || chr(10) END, '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""",
    "infer_seqlen_pairs": """WITH p AS (SELECT conv_id, turn, length(prompt) AS s, length(text) AS t FROM (SELECT *, lag(text) OVER w AS prompt, lag(role) OVER w AS before
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND before = 'user'),
m AS (SELECT *, least(t, CASE WHEN t * 2 < 150 THEN 150 WHEN s * 2 < 150 THEN 150 - s ELSE CAST(floor(150.0::DOUBLE * t / (s + t)) AS BIGINT) END) AS n FROM p)
SELECT conv_id, turn, least(greatest(150 - n, 0), s) AS source_len, n AS target_len FROM m""",
    "pretrain_blocks": f"""WITH b AS (SELECT rn // 100 AS batch, sum(n + 1) // 128 AS k FROM {_PIECES_SQL} GROUP BY 1)
SELECT CAST(batch AS BIGINT) AS batch, CAST(k AS BIGINT) AS n, CAST(k * 128 AS BIGINT) AS tokens FROM b WHERE k > 0""",
    "pad_collate_stats": f"""SELECT CAST(rn // 8 AS BIGINT) AS batch, CAST(CAST(ceil(max(n) / 8.0) AS BIGINT) * 8 * count(*) AS BIGINT) AS padded, CAST(sum(n) AS BIGINT) AS valid FROM {_PIECES_SQL} GROUP BY 1""",
    "valid_token_ratio": f"""WITH b AS (SELECT rn // 16 AS batch, sum(len([x FOR x IN ids IF x > 5])) AS v, max(n) * count(*) AS t FROM {_PIECES_SQL} GROUP BY 1), s AS (SELECT sum(v) AS v, sum(t) AS t FROM b)
SELECT CAST(v AS BIGINT) AS valid, CAST(t AS BIGINT) AS total, round(v::DOUBLE / t, 9) AS ratio, round(3e-4::DOUBLE * sqrt(2048 * 16 * (v::DOUBLE / t) / 4000000), 12) AS lr FROM s""",
    "qa_dedup_first": "SELECT doc_id, text, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "length_cdf": """WITH n AS (SELECT CAST(floor(length(text) / 1000) * 1000 AS BIGINT) AS bucket, count(*) AS n FROM documents GROUP BY 1)
SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) AS DOUBLE) / (SELECT sum(n) FROM n) AS share FROM n""",
    "kept_ratio": f"""SELECT lang, source, count(*) AS n, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS n_kept, count(*) FILTER (quality = 1)::DOUBLE / count(*) AS kept_ratio
FROM {_LABELLED_SQL} GROUP BY ROLLUP (lang, source)""",
    "category_accuracy": f"""SELECT coalesce(lang, 'Average') AS category, count(*) AS n, round(100 * (count(*) FILTER (quality <> toxic))::DOUBLE / count(*), 2) AS accuracy FROM {_LABELLED_SQL} GROUP BY ROLLUP (lang)""",
    "mix_concat": "SELECT doc_id, lang, CAST(CASE lang WHEN 'en' THEN 0 ELSE 1 END AS INTEGER) AS dataset FROM documents WHERE lang IN ('en', 'de')",
    "mix_interleave_under": f"WITH {_PARTS_SQL} SELECT doc_id, r.lang, rank, CAST((rank - 1) * k + place AS BIGINT) AS position FROM r JOIN p USING (lang), b WHERE rank <= lo",
    "mix_interleave_over": f"WITH {_PARTS_SQL} SELECT doc_id, r.lang, rank, CAST(i * k + place AS BIGINT) AS position FROM r JOIN p USING (lang), b, LATERAL (SELECT unnest(range(rank - 1, hi, size)) AS i)",
    "split_counts": """WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*) * 0.1::DOUBLE) AS BIGINT) AS v FROM documents)
SELECT 'validation' AS split, v AS n, v AS docs FROM n UNION ALL SELECT 'train', n - v, n - v FROM n""",
    "sample_with_replacement": "SELECT count(*) + count(*) // 2 AS n, count(*) AS docs FROM documents",
    "tag_extract": r"SELECT page_id, regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 'is'), '^\s+|\s+$', '', 'g') AS title FROM pages",
    "answer_extract": r"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '\\boxed\{([^}]*)\}', 1)[-1] AS b, regexp_extract_all(lower(text), 'the answer is\s*([^\n.]+)', 1)[-1] AS p1,
regexp_extract_all(lower(text), 'answer:\s*([^\n.]+)', 1)[-1] AS p2, regexp_extract_all(lower(text), 'final answer:\s*([^\n.]+)', 1)[-1] AS p3, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[-1] AS l FROM documents)
SELECT doc_id, regexp_replace(coalesce(b, p1, p2, p3, l), '^\s+|\s+$', '', 'g') AS answer FROM a""",
    "answer_normalize": "SELECT p_partkey, p_name AS answer FROM part",
    "ema_smooth": """WITH RECURSIVE e AS (SELECT user_id AS run, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, 1.8 * (1 / (1 + exp(-0.05 * count(*) OVER (PARTITION BY user_id))) - 0.5) AS w FROM events),
r AS (SELECT run, event_id, i, w, value AS v FROM e WHERE i = 1 UNION ALL SELECT e.run, e.event_id, e.i, e.w, r.v * e.w + (1 - e.w) * e.value FROM r JOIN e ON e.run = r.run AND e.i = r.i + 1)
SELECT run, event_id AS current_steps, round(v, 6) AS smoothed FROM r""",
    "latest_log": "SELECT user_id AS run, max(event_id) AS current_steps, arg_max(value, event_id) AS loss FROM events GROUP BY 1",
    "running_meter": 'SELECT event_id // 50 AS "window", round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6) AS mean FROM events GROUP BY 1',
    "progress_eta": """SELECT event_id, round(100.0::DOUBLE * (event_id % 1000) / 1000, 2) AS percentage, printf('%d:%02d:%02d', (event_id % 977) * 13 // 3600, (event_id % 977) * 13 % 3600 // 60, (event_id % 977) * 13 % 60) AS elapsed_time FROM events""",
    "benchmark_compare": """WITH s AS (SELECT user_id % 3 AS m, event_type, round(avg(value)) / 1000 AS v FROM events GROUP BY 1, 2)
SELECT event_type AS benchmark, coalesce(max(printf('%.1f%%', v * 100)) FILTER (m = 0), 'N/A') AS m0, coalesce(max(printf('%.1f%%', v * 100)) FILTER (m = 1), 'N/A') AS m1, 'N/A' AS m9 FROM s GROUP BY 1""",
    "preference_accuracy": f"""WITH m AS (SELECT avg(n_chars) FILTER (quality = 1) AS c, avg(n_chars) FILTER (quality = 0) AS r FROM {_LABELLED_SQL} GROUP BY source)
SELECT round(avg(CAST(c > r AS INTEGER)), 6) AS accuracy FROM m""",
    "feedback_rewards": f"""WITH m AS (SELECT sum(n_chars) FILTER (quality = 1)::DOUBLE / count(*) FILTER (quality = 1) AS c, sum(n_chars) FILTER (quality <> 1)::DOUBLE / count(*) FILTER (quality <> 1) AS r FROM {_LABELLED_SQL})
SELECT round(c, 4) AS rewards_chosen, round(r, 4) AS rewards_rejected, round(c - r, 4) AS rewards_margins FROM m""",
    "json_props_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
