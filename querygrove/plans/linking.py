"""Linking of names to nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import linking as L
from ..sources.star import Star, pid
from .registry import query

_N = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _N.format(x)


def _form(x: str) -> str:
    return f"array_to_string(list_sort(string_split({_norm(x)}, ' ')), ' ')"


#: In Spark the test names are ASCII, so the function that stays in the JVM is exact for them.
ASCII = X.normalised_ascii


@query(r"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(translate(text, 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy'), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS normal FROM documents", graph=False)
def normalize_texts(s: Star) -> DataFrame:
    """Accents off, the rest that isn't ASCII gone."""
    return s.table("documents").select("doc_id", X.normalised(F.col("text")).alias("normal"))


@query(f"SELECT p_partkey, {_norm('p_name')} AS normal, {_form('p_name')} AS form FROM part", graph=False)
def name_forms(s: Star) -> DataFrame:
    n = ASCII(F.col("p_name"))
    return s.table("part").select("p_partkey", n.alias("normal"), X.form(n).alias("form"))


@query(r"SELECT p_partkey, regexp_replace(t, '\([^)]*\)', ' ', 'g') AS outside, array_to_string(regexp_extract_all(t, '\(([^)]*)\)', 1), '|') AS inside FROM (SELECT p_partkey, p_name || ' (' || p_brand || ') x (' || p_type || ')' AS t FROM part)", graph=False)
def bracket_parts(s: Star) -> DataFrame:
    t = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") x ("), "p_type", F.lit(")"))
    return s.table("part").select("p_partkey", X.without_brackets(t).alias("outside"), F.array_join(X.in_brackets(t), "|").alias("inside"))


def _named(s: Star) -> DataFrame:
    return L.names(s.nodes)


_NAMED = "x_named AS (SELECT label AS kind, id, name FROM g_nodes WHERE NOT is_group AND name IS NOT NULL AND NOT regexp_matches(name, '^CHEMBL[0-9]+$'))"


@query(_NAMED + " SELECT kind, id, name FROM x_named")
def node_names(s: Star) -> DataFrame:
    return _named(s)


_SYN = "x_syn AS (SELECT 'Gene' AS kind, 'P' || p_partkey AS id, 'symbol' AS source, p_brand || '|' || p_type || ' (old)|x' AS forms FROM part UNION ALL SELECT 'Gene', 'Q' || p_partkey, 'name', p_name FROM part)"


def _synonyms(s: Star) -> DataFrame:
    p = s.table("part")
    a = p.select(F.lit("Gene").alias("kind"), pid("p_partkey").alias("id"), F.lit("symbol").alias("source"), F.concat("p_brand", F.lit("|"), "p_type", F.lit(" (old)|x")).alias("forms"))
    return L.synonyms(a.unionByName(p.select(F.lit("Gene").alias("kind"), F.concat(F.lit("Q"), "p_partkey").alias("id"), F.lit("name").alias("source"), F.col("p_name").alias("forms"))), _named(s))


@query(rf"""{_NAMED}, {_SYN} SELECT kind, id, regexp_replace(name, '\([^)]*\)', ' ', 'g') AS name FROM (SELECT kind, id, source, unnest(string_split(forms, '|')) AS name FROM x_syn) WHERE (source = 'name' OR length(name) >= 3) AND id IN (SELECT id FROM x_named)""")
def synonym_table(s: Star) -> DataFrame:
    """Synonyms of known nodes, a row each."""
    return _synonyms(s)


_DICT = rf"""{_NAMED}, {_SYN}, x_all AS (SELECT 0 AS level, kind, id, name FROM x_named UNION ALL SELECT 1, kind, id, regexp_replace(name, '\([^)]*\)', ' ', 'g') FROM (SELECT kind, id, source, unnest(string_split(forms, '|')) AS name FROM x_syn) WHERE (source = 'name' OR length(name) >= 3) AND id IN (SELECT id FROM x_named)),
x_dict AS (SELECT level, kind, {_form('name')} AS form, id, count(*) AS votes FROM x_all WHERE {_form('name')} <> '' GROUP BY ALL)"""


def _dictionary(s: Star) -> DataFrame:
    return L.dictionary(_named(s), 0, ASCII).unionByName(L.dictionary(_synonyms(s), 1, ASCII))


@query(_DICT + " SELECT level, kind, form, id, votes FROM x_dict")
def vote_dictionary(s: Star) -> DataFrame:
    return _dictionary(s)


#: Mentions: words of part names turned round, brands, and names with more around them.
_MENTIONS = """x_m AS (SELECT 'm' || p_partkey AS mention, 'Gene' AS kind, CASE p_partkey % 3 WHEN 0 THEN string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] WHEN 1 THEN 'the ' || p_brand ELSE p_brand END AS name FROM part
UNION ALL SELECT 'd' || c_custkey, 'Disease', 'severe ' || c_name || ' type' FROM customer)"""


def _mentions(s: Star) -> DataFrame:
    w = F.split("p_name", " ")
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(w[1], F.lit(" "), w[0])).when(k % 3 == 1, F.concat(F.lit("the "), "p_brand")).otherwise(F.col("p_brand"))
    a = s.table("part").select(F.concat(F.lit("m"), "p_partkey").alias("mention"), F.lit("Gene").alias("kind"), name.alias("name"))
    return a.unionByName(s.table("customer").select(F.concat(F.lit("d"), "c_custkey").alias("mention"), F.lit("Disease").alias("kind"), F.concat(F.lit("severe "), "c_name", F.lit(" type")).alias("name")))


def _untie(hit: str) -> str:
    """Tie rule over a table of (mention, kind, id, votes)."""
    return f"""x_top AS (SELECT mention, kind, id, votes, rank() OVER (PARTITION BY mention, kind ORDER BY votes DESC) AS r FROM (SELECT mention, kind, id, max(votes) AS votes FROM {hit} GROUP BY 1, 2, 3)),
x_tied AS (SELECT t.mention, t.kind, t.id, count(*) OVER (PARTITION BY t.mention, t.kind) AS tied, row_number() OVER (PARTITION BY mention, t.kind ORDER BY len(string_split({_norm("n.name")}, ' ')), length(n.name), t.id) AS place FROM x_top t JOIN x_named n ON n.kind = t.kind AND n.id = t.id WHERE r = 1),
x_res AS (SELECT mention, kind, id FROM x_tied WHERE tied <= 2 OR place = 1)"""


_EXACT = f"""{_DICT}, {_MENTIONS}, x_hit AS (SELECT mention, m.kind, id, votes, dense_rank() OVER (PARTITION BY mention, m.kind ORDER BY level) AS f FROM x_m m JOIN x_dict d ON d.kind = m.kind AND d.form = {_form('m.name')}), x_first AS (SELECT * FROM x_hit WHERE f = 1), {_untie('x_first')}"""


@query(_EXACT + " SELECT mention, kind, id FROM x_res")
def link_exact(s: Star) -> DataFrame:
    """Whole forms, names before synonyms, ties untied."""
    return L.exact(_mentions(s).withColumn("place", F.lit(0)), _dictionary(s), _named(s), ASCII)


@query(f"""{_NAMED}, x_v AS (SELECT DISTINCT 'o' || l_orderkey AS mention, 'Gene' AS kind, 'P' || l_partkey AS id, l_linenumber % 2 AS votes FROM lineitem), {_untie('x_v')} SELECT mention, kind, id FROM x_res""")
def link_tiebreak(s: Star) -> DataFrame:
    """Two tied nodes at most, else the one of the shortest name."""
    v = s.table("lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("mention"), F.lit("Gene").alias("kind"), pid("l_partkey").alias("id"), (F.col("l_linenumber") % 2).alias("votes"))
    return L.untied(v.distinct(), _named(s), ASCII).select("mention", "kind", "id")


_STOP = ", ".join(f"'{w}'" for w in L.EMPTY_WORDS + L.GENERIC_WORDS)


@query(f"""{_DICT}, {_MENTIONS}, x_w AS (SELECT mention, kind, string_split({_norm('name')}, ' ') AS w FROM x_m WHERE kind = 'Disease'), x_spans AS (SELECT mention, kind, w, n, unnest(range(1, len(w) - n + 2)) AS st FROM (SELECT mention, kind, w, unnest(range(1, len(w) + 1)) AS n FROM x_w)),
x_seg AS (SELECT mention, kind, n, st, list_slice(w, st, st + n - 1) AS ws FROM x_spans), x_sh AS (SELECT mention, x_seg.kind, id, votes, dense_rank() OVER (PARTITION BY mention ORDER BY n DESC, st DESC, level) AS f FROM x_seg JOIN x_dict d ON d.kind = x_seg.kind AND d.form = array_to_string(list_sort(ws), ' ') WHERE len(list_filter(ws, lambda x: x NOT IN ({_STOP}))) > 0),
x_first AS (SELECT * FROM x_sh WHERE f = 1), {_untie('x_first')} SELECT mention, kind, id FROM x_res""")
def link_segments(s: Star) -> DataFrame:
    """The longest, then rightmost window of words that is a form."""
    return L.segments(_mentions(s), _dictionary(s), _named(s), ASCII).select("mention", "kind", "id")


@query(f"""{_DICT}, {_MENTIONS}, x_hit AS (SELECT mention, m.kind, id, votes, dense_rank() OVER (PARTITION BY mention, m.kind ORDER BY level) AS f FROM x_m m JOIN x_dict d ON d.kind = m.kind AND d.form = {_form('m.name')}), x_first AS (SELECT * FROM x_hit WHERE f = 1), {_untie('x_first')},
x_w AS (SELECT mention, kind, string_split({_norm('name')}, ' ') AS w FROM x_m WHERE kind = 'Disease' AND mention NOT IN (SELECT mention FROM x_res)), x_spans AS (SELECT mention, kind, w, n, unnest(range(1, len(w) - n + 2)) AS st FROM (SELECT mention, kind, w, unnest(range(1, len(w) + 1)) AS n FROM x_w)),
x_seg AS (SELECT mention, kind, n, st, list_slice(w, st, st + n - 1) AS ws FROM x_spans), x_sh AS (SELECT mention, x_seg.kind, id, votes, dense_rank() OVER (PARTITION BY mention ORDER BY n DESC, st DESC, level) AS f FROM x_seg JOIN x_dict d ON d.kind = x_seg.kind AND d.form = array_to_string(list_sort(ws), ' ') WHERE len(list_filter(ws, lambda x: x NOT IN ({_STOP}))) > 0),
x_first2 AS (SELECT * FROM x_sh WHERE f = 1), {_untie('x_first2').replace('x_top', 'x_top2').replace('x_tied', 'x_tied2').replace('x_res', 'x_res2')}
SELECT mention, kind, id, 'diccionario' AS how FROM x_res UNION ALL SELECT mention, kind, id, 'segmentos' FROM x_res2""")
def link_mentions(s: Star) -> DataFrame:
    """Both ways, in order."""
    m = _mentions(s).select("mention", "kind", F.col("name").alias("text"), F.col("name").alias("english"))
    return L.link(m, _dictionary(s), _named(s), ASCII)


@query("""SELECT c_custkey, t AS text, k AS kind, coalesce(nullif(e, ''), t) AS english FROM (SELECT c_custkey, c_name AS t, CASE WHEN c_custkey % 2 = 0 THEN 'Disease' ELSE 'City' END AS k, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE upper(c_name) END AS e FROM customer WHERE c_custkey % 5 <> 0) WHERE k = 'Disease'""", graph=False)
def parse_mentions(s: Star) -> DataFrame:
    """Mentions in JSON answers; broken JSON and unknown kinds have none."""
    k = F.col("c_custkey")
    one = F.struct(F.col("c_name").alias("texto"), F.when(k % 2 == 0, "Disease").otherwise("City").alias("tipo"), F.when(k % 4 == 0, "").otherwise(F.upper("c_name")).alias("nombre_en_ingles"))
    j = F.when(k % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.array(one).alias("menciones"))))
    return L.mentions(s.table("customer").select("c_custkey", j.alias("answer")), "answer").select("c_custkey", "text", "kind", "english")


@query(r"SELECT conv_id, turn, regexp_replace(lower(role || ' ' || substr(text, 1, 20)), '[^a-z0-9]+', '_', 'g') || '_' || substr('000000' || conv_id, -6) AS slug FROM conversations", graph=False)
def slug_names(s: Star) -> DataFrame:
    ident: Column = F.concat(F.lit("000000"), "conv_id")
    return s.table("conversations").select("conv_id", "turn", X.slug(F.concat("role", F.lit(" "), F.substring("text", 1, 20)), ident).alias("slug"))


@query(r"""x_b AS (SELECT conv_id, turn, trim(regexp_replace(lower(role), '[^a-z0-9]+', '_', 'g'), '_') AS base, 'q' || lpad(CAST(turn AS VARCHAR), 4, '0') || 'x' || lpad(CAST(conv_id AS VARCHAR), 12, '0') AS ident FROM conversations), x_r AS (SELECT *, base || '_' || right(ident, 6) AS short FROM x_b)
SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY short ORDER BY ident) = 1 THEN short ELSE base || '_' || ident END AS slug FROM x_r""")
def unique_slugs(s: Star) -> DataFrame:
    """Names of questions, with the whole id where the short ones clash."""
    ident = F.concat(F.lit("q"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit("x"), F.lpad(F.col("conv_id").cast("string"), 12, "0"))
    return X.unique_slugs(s.table("conversations").select("conv_id", "turn", "role", ident.alias("ident")), "role", "ident").select("conv_id", "turn", "slug")


@query("""x_f AS (SELECT DISTINCT o_custkey AS question, l_partkey AS id FROM g_sold WHERE l_quantity >= 45), x_e AS (SELECT DISTINCT o_custkey AS question, l_partkey AS id FROM g_sold WHERE l_quantity >= 45 AND (l_returnflag <> 'R' OR o_custkey % 2 = 0)), x_all AS (SELECT DISTINCT question FROM x_f)
SELECT question, NOT EXISTS (SELECT 1 FROM x_f f WHERE f.question = a.question AND NOT EXISTS (SELECT 1 FROM x_e e WHERE e.question = f.question AND e.id = f.id)) AS same FROM x_all a""")
def same_entities(s: Star) -> DataFrame:
    """Whether linking again finds the entities of before."""
    found = s.sold.where("l_quantity >= 45").select(F.col("o_custkey").alias("question"), F.lit("Gene").alias("label"), F.col("l_partkey").alias("id"), "l_returnflag")
    return L.same_sets(found.drop("l_returnflag"), found.where("l_returnflag <> 'R' OR question % 2 = 0").drop("l_returnflag"))


@query("""x_k AS (SELECT l_suppkey, string_agg(DISTINCT 'Gene_P' || l_partkey, '__' ORDER BY 'Gene_P' || l_partkey) AS k FROM lineitem WHERE l_quantity >= 49 GROUP BY 1)
SELECT l_suppkey, CASE WHEN length(k) > 150 THEN substr(k, 1, 100) || '_' || substr(md5(k), 1, 8) ELSE k END AS key FROM x_k""")
def set_key(s: Star) -> DataFrame:
    """A name for each set of entities."""
    g = s.table("lineitem").where("l_quantity >= 49").groupBy("l_suppkey").agg(F.collect_set(F.concat(F.lit("Gene_P"), "l_partkey")).alias("e"))
    return g.select("l_suppkey", X.set_key(F.col("e")).alias("key"))


@query("""x_links AS (SELECT DISTINCT l_orderkey AS question, 'P' || l_partkey AS node FROM lineitem WHERE l_returnflag <> 'R'), x_gold AS (SELECT DISTINCT l_orderkey AS question, 'P' || l_partkey AS node FROM lineitem WHERE l_quantity >= 48)
SELECT DISTINCT question FROM x_links WHERE question NOT IN (SELECT l.question FROM x_links l JOIN x_gold g ON g.question = l.question AND g.node = l.node)""")
def answer_not_entity(s: Star) -> DataFrame:
    """Questions whose entities hold no gold node."""
    li = s.table("lineitem").select(F.col("l_orderkey").alias("question"), pid("l_partkey").alias("node"), "l_returnflag", "l_quantity")
    links, gold = li.where("l_returnflag <> 'R'").select("question", "node").distinct(), li.where("l_quantity >= 48").select("question", "node").distinct()
    return links.select("question").distinct().join(links.join(gold, ["question", "node"]).select("question"), "question", "left_anti")


@query("SELECT DISTINCT label_a AS label, id_a AS id FROM g_both WHERE type IN ('GDA', 'INDICATION', 'DRUG_TARGET')")
def has_layer_neighbours(s: Star) -> DataFrame:
    """Nodes with a neighbour of another label through a layer."""
    from ..operators import graph

    return graph.both_ways(s.edges("GDA", "INDICATION", "DRUG_TARGET")).select(F.col("label_a").alias("label"), F.col("id_a").alias("id")).distinct()


_GOLD = "x_gs AS (SELECT c_custkey AS question, n_nationkey AS item, n_name AS synonym FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 1000 + p_partkey, p_brand FROM customer JOIN part ON p_partkey = c_custkey)"


@query(f"{_DICT}, {_GOLD}, x_k(kind) AS (VALUES ('Gene'), ('Disease'), ('Drug')), x_hit AS (SELECT DISTINCT question, item FROM x_gs JOIN x_k ON true JOIN x_dict d ON d.kind = x_k.kind AND d.form = {_form('synonym')}) SELECT g.question, count(DISTINCT g.item) AS items, count(DISTINCT h.item) AS linked FROM x_gs g LEFT JOIN x_hit h ON h.question = g.question AND h.item = g.item GROUP BY 1")
def gold_linking(s: Star) -> DataFrame:
    """Gold items that some synonym, of any kind, links to a node."""
    c = s.table("customer")
    a = c.join(s.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("question"), F.col("n_nationkey").cast("long").alias("item"), F.col("n_name").alias("synonym"))
    b = c.join(s.table("part"), F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("question"), (F.col("p_partkey") + 1000).alias("item"), F.col("p_brand").alias("synonym"))
    gold = a.unionByName(b)
    tried = gold.select(F.to_json(F.struct("question", "item")).alias("mention"), F.explode(F.array(*map(F.lit, L.KINDS))).alias("kind"), F.lit(0).alias("place"), F.col("synonym").alias("name"))
    hit = L.exact(tried, _dictionary(s), _named(s), ASCII).select(F.from_json("mention", "question long, item long").alias("m")).select("m.*").distinct().select("question", F.col("item").alias("hit"))
    g = gold.select("question", "item").distinct().join(hit.withColumn("item", F.col("hit")), ["question", "item"], "left")
    return g.groupBy("question").agg(F.countDistinct("item").alias("items"), F.countDistinct("hit").alias("linked"))


@query(_EXACT + ", x_qm AS (SELECT CAST(substr(mention, 2) AS BIGINT) % 50 AS question, mention, kind FROM x_m WHERE kind = 'Gene') SELECT question, count(*) AS mentions, count(*) FILTER (mention IN (SELECT mention FROM x_res)) AS linked, bool_and(mention IN (SELECT mention FROM x_res)) AS all_linked FROM x_qm GROUP BY 1")
def question_links(s: Star) -> DataFrame:
    """Whether all mentions of a question link."""
    m = _mentions(s).where("kind = 'Gene'")
    hit = L.exact(m.withColumn("place", F.lit(0)), _dictionary(s), _named(s), ASCII).select("mention", F.lit(True).alias("hit")).distinct()
    q = m.join(hit, "mention", "left").withColumn("question", F.substring("mention", 2, 20).cast("long") % 50).withColumn("hit", F.coalesce("hit", F.lit(False)))
    return q.groupBy("question").agg(F.count("*").alias("mentions"), F.count_if("hit").alias("linked"), F.every("hit").alias("all_linked"))
