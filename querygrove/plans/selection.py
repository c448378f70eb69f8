"""Selection of subgraphs, their wording and text units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import expand, graph, select, units
from ..sources.schema import STEPS
from ..sources.star import Star
from ..storage import materialise
from .network import ROUNDS, planes, transition
from .registry import query

_ENT = "x_ent AS (SELECT label, id FROM g_nodes WHERE id IN ('S1', 'C7', 'P3'))"
#: The relation, origin and target of each step, as SQL rows.
_STEPS = "x_steps(step, origin, target, relation, plane) AS (VALUES " + ", ".join(f"('{t.name}', '{t.origin}', '{t.target}', '{t.relation}', '{t.plane}')" for t in STEPS.values()) + ")"
_GROUPS = "x_groups AS (SELECT e.label, e.id, g.id_a AS group_id FROM x_ent e JOIN g_edges g ON g.type = 'DISEASE_BERT' AND g.id_b = e.id)"
_HARVEST = f"""{_ENT}, {_STEPS}, {_GROUPS}, x_at AS (SELECT label, id, id AS at FROM x_ent UNION ALL SELECT label, id, group_id FROM x_groups),
x_harvest AS (SELECT DISTINCT step, x.label AS entity_label, x.id AS entity_id, target, plane, b.id_b AS seed FROM x_at x JOIN x_steps s ON s.origin = x.label JOIN g_both b ON b.type = relation AND b.label_a = origin AND b.label_b = target AND b.id_a = x.at),
x_roles AS (SELECT target AS label, seed AS id, entity_label, entity_id, step, CASE WHEN EXISTS (SELECT 1 FROM g_plane p WHERE p.plane = h.plane AND p.src = seed) THEN 'semilla' ELSE 'vecino_fuera_del_plano' END AS role FROM x_harvest h)"""


def entities(s: Star) -> DataFrame:
    return s.nodes.where("id IN ('S1', 'C7', 'P3')").select("label", "id")


def _edges(s: Star) -> DataFrame:
    return s.edges()


@query(_HARVEST + " SELECT step, entity_label, entity_id, seed FROM x_harvest")
def harvest_neighbors(s: Star) -> DataFrame:
    """Neighbours of the entities, and of their groups, for each step."""
    e, out = _edges(s), None
    for t in STEPS.values():
        one = select.harvest(e, entities(s), t).select(F.lit(t.name).alias("step"), "entity_label", "entity_id", "seed")
        out = one if out is None else out.unionByName(one)
    return out


@query("""x_s AS (SELECT DISTINCT b.id_a AS entity, b.id_b AS seed FROM g_both b WHERE type = 'GDA' AND label_a = 'Disease' AND b.id_b IN (SELECT src FROM g_plane WHERE plane = 'gene'))
SELECT entity, count(*) AS n_seeds, string_agg(seed, '|' ORDER BY seed) AS seeds FROM x_s GROUP BY 1""")
def effective_seeds(s: Star) -> DataFrame:
    """Seeds in the plane for every entity of a step."""
    out = select.all_seeds(s.edges("GDA"), s.nodes, STEPS["disease_a_gene"], planes(s)["gene"])
    return out.select("entity", "n_seeds", F.array_join("seeds", "|").alias("seeds"))


@query(_HARVEST + " SELECT * FROM x_roles")
def roles(s: Star) -> DataFrame:
    e, p, out = _edges(s), planes(s), None
    for t in STEPS.values():
        one = select.roles(select.harvest(e, entities(s), t), p[t.plane], t)
        out = one if out is None else out.unionByName(one)
    return out.select("label", "id", "entity_label", "entity_id", "step", "role")


@query(_ENT + " SELECT label, id FROM x_ent UNION ALL SELECT label, id FROM g_nodes WHERE id = 'none'")
def entity_validation(s: Star) -> DataFrame:
    """The asked entities that exist."""
    asked = s.spark.createDataFrame([("Drug", "S1"), ("Disease", "C7"), ("Gene", "P3"), ("Drug", "none"), ("Gene", "S1")], "label string, id string")
    return select.known(asked, s.nodes)


#: A made-up long table of reasons, by arithmetic on suppliers and parts, for the set operations.
_REASONS = """x_reasons AS (SELECT 'Gene' AS label, 'P' || l_partkey AS id, 'Drug' AS entity_label, 'S' || l_suppkey AS entity_id, 'drug_a_gene' AS step,
CASE WHEN l_linenumber <= 2 THEN 'semilla' ELSE 'agregado' END AS role, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS iteration,
CASE WHEN l_linenumber <= 2 THEN NULL WHEN l_orderkey % 3 = 0 THEN 'diamond' WHEN l_orderkey % 3 = 1 THEN 'c3' ELSE 'rwr' END AS method FROM lineitem)"""


def _reasons(s: Star) -> DataFrame:
    n = F.col("l_linenumber")
    method = F.when(n <= 2, F.lit(None).cast("string")).when(F.col("l_orderkey") % 3 == 0, "diamond").when(F.col("l_orderkey") % 3 == 1, "c3").otherwise("rwr")
    return s.table("lineitem").select(
        F.lit("Gene").alias("label"), F.concat(F.lit("P"), "l_partkey").alias("id"), F.lit("Drug").alias("entity_label"), F.concat(F.lit("S"), "l_suppkey").alias("entity_id"), F.lit("drug_a_gene").alias("step"),
        F.when(n <= 2, "semilla").otherwise("agregado").alias("role"), F.when(n > 2, n).alias("iteration"), F.lit(None).cast("double").alias("p_value"), method.alias("method"),
    )


@query(_REASONS + """, x_conf(configuration, methods) AS (VALUES ('semillas', []::VARCHAR[]), ('diamond', ['diamond']), ('diamond_c3', ['diamond', 'c3']), ('completa', ['diamond', 'c3', 'rwr']))
SELECT configuration, label, id, count(*) AS reasons FROM x_reasons JOIN x_conf ON role <> 'agregado' OR list_contains(methods, method) GROUP BY ALL""")
def config_filter(s: Star) -> DataFrame:
    """One selection through all configurations."""
    return select.ablation(_reasons(s)).groupBy("configuration", "label", "id").agg(F.count("*").alias("reasons"))


@query(_REASONS + " SELECT label, id, CASE min(CASE WHEN role <> 'agregado' THEN 0 WHEN method = 'diamond' THEN 1 WHEN method = 'c3' THEN 2 ELSE 3 END) WHEN 0 THEN 'semilla' WHEN 1 THEN 'diamond' WHEN 2 THEN 'c3' ELSE 'rwr' END AS origin FROM x_reasons GROUP BY 1, 2")
def origin_of_node(s: Star) -> DataFrame:
    return select.origin_of(_reasons(s))


@query(_REASONS + " SELECT label, id, count(*) AS n, count(DISTINCT coalesce(method, '')) AS methods FROM x_reasons GROUP BY 1, 2")
def union_provenance(s: Star) -> DataFrame:
    """Reasons kept as one array per node."""
    p = select.provenances(_reasons(s))
    return p.select("label", "id", F.size("provenances").cast("long").alias("n"), F.size(F.array_distinct(F.transform("provenances", lambda x: F.coalesce(x["method"], F.lit(""))))).cast("long").alias("methods"))


@query(_REASONS + """ SELECT label, id, string_agg('{"step":"' || step || '","role":"' || role || '","method":' || coalesce('"' || method || '"', 'null') || '}', ',' ORDER BY role, coalesce(iteration, 0), coalesce(method, '')) AS json FROM x_reasons GROUP BY 1, 2""")
def provenance_json(s: Star) -> DataFrame:
    """Reasons as JSON that keeps nulls."""
    one = F.to_json(F.struct("step", "role", "method"), {"ignoreNullFields": "false"})
    r = _reasons(s).withColumn("j", F.struct("role", F.coalesce("iteration", F.lit(0)).alias("i"), F.coalesce("method", F.lit("")).alias("m"), one.alias("json")))
    return r.groupBy("label", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("j")), lambda x: x["json"]), ",").alias("json"))


_CHOSEN = "x_chosen AS (SELECT label, id FROM g_nodes WHERE ends_with(id, '1') OR ends_with(id, '5')), x_ind AS (SELECT e.* FROM g_edges e JOIN x_chosen a ON a.label = label_a AND a.id = id_a JOIN x_chosen b ON b.label = label_b AND b.id = id_b)"


def _chosen(s: Star) -> DataFrame:
    return s.nodes.where(F.col("id").endswith("1") | F.col("id").endswith("5"))


@query(_CHOSEN + " SELECT type, label_a, id_a, label_b, id_b, weight FROM x_ind")
def induced_subgraph(s: Star) -> DataFrame:
    """All edges with both ends chosen."""
    return s.induced(_chosen(s)).select("type", "label_a", "id_a", "label_b", "id_b", "weight")


@query(_CHOSEN + """ SELECT 'label' AS kind, label AS value, count(*) AS n FROM x_chosen GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM x_ind GROUP BY 2 UNION ALL SELECT 'origin', 'semilla', count(*) FROM x_chosen""")
def subgraph_statistics(s: Star) -> DataFrame:
    c = _chosen(s)
    origin = select.origin_of(c.select("label", "id", F.lit("semilla").alias("role"), F.lit(None).cast("string").alias("method")))
    return select.statistics(c, s.induced(c), origin)


@query("""SELECT label, id, coalesce(name, id) AS name FROM g_nodes WHERE label IN ('Gene', 'Disease', 'Drug')""")
def whole_graph_nodes(s: Star) -> DataFrame:
    return graph.export(s.nodes, s.edges("PPI"))[0]


@query("SELECT type, label_a, id_a, label_b, id_b FROM g_edges WHERE type IN ('GDA', 'PATHWAY_PROTEIN', 'DRUG_DRUG') AND label_a IN ('Gene', 'Disease', 'Drug') AND label_b IN ('Gene', 'Disease', 'Drug')")
def whole_graph_edges(s: Star) -> DataFrame:
    return graph.export(s.nodes, s.edges("GDA", "PATHWAY_PROTEIN", "DRUG_DRUG"))[1].select("type", "label_a", "id_a", "label_b", "id_b")


_SAY = """CASE type WHEN 'DRUG_TARGET' THEN 'The drug ' || a || ' targets the protein encoded by ' || b || '.' WHEN 'GDA' THEN 'The gene ' || a || ' is associated with ' || b || '.' WHEN 'INDICATION' THEN 'The drug ' || a || ' is indicated for ' || b || '.'
WHEN 'PPI' THEN 'The proteins ' || a || ' and ' || b || ' interact.' WHEN 'DRUG_DRUG' THEN 'The drugs ' || a || ' and ' || b || ' are chemically similar.' WHEN 'PATHWAY_PROTEIN' THEN 'The protein encoded by ' || b || ' participates in the pathway ' || a || '.'
ELSE 'The diseases ' || a || ' and ' || b || ' are related.' END"""


@query(f"SELECT type, id_a, id_b, {_SAY} AS sentence FROM (SELECT e.*, x.name AS a, y.name AS b FROM g_edges e JOIN g_nodes x ON x.label = label_a AND x.id = id_a JOIN g_nodes y ON y.label = label_b AND y.id = id_b)")
def edge_sentences(s: Star) -> DataFrame:
    """Every edge as a sentence."""
    return s.induced(named=True).select("type", "id_a", "id_b", X.sentence(F.col("type"), F.col("a"), F.col("label_a"), F.col("b")).alias("sentence"))


_TITLES = """x_t1 AS (SELECT label, id, upper(coalesce(name, id)) AS t1 FROM g_nodes), x_t2 AS (SELECT label, id, CASE WHEN count(*) OVER (PARTITION BY t1) > 1 THEN t1 || ' (' || upper(label) || ')' ELSE t1 END AS t2 FROM x_t1),
x_titles AS (SELECT label, id, CASE WHEN count(*) OVER (PARTITION BY t2) > 1 THEN t2 || ' [' || id || ']' ELSE t2 END AS title FROM x_t2)"""


@query(_TITLES + " SELECT label, id, title FROM x_titles")
def unique_titles(s: Star) -> DataFrame:
    return units.titles(s.nodes).select("label", "id", "title")


_REL = f"""{_CHOSEN}, {_TITLES}, x_e AS (SELECT row_number() OVER (ORDER BY type, id_a, id_b) - 1 AS r, type, x.title AS a, y.title AS b, id_a, id_b FROM x_ind e JOIN x_titles x ON x.label = label_a AND x.id = id_a JOIN x_titles y ON y.label = label_b AND y.id = id_b),
x_deg AS (SELECT id, count(*) AS degree FROM (SELECT id_a AS id FROM x_ind UNION ALL SELECT id_b FROM x_ind) GROUP BY 1), x_rel AS (SELECT x_e.*, {_SAY} AS description, p.degree + q.degree AS combined_degree FROM x_e JOIN x_deg p ON p.id = id_a JOIN x_deg q ON q.id = id_b)"""


def _relations(s: Star) -> tuple[DataFrame, DataFrame, DataFrame]:
    titled = units.titles(s.nodes).select("label", "id", "title")
    e = s.induced(_chosen(s))
    return titled, e, units.relationships(e, titled)


@query(_REL + " SELECT r, a AS source, b AS target, description, combined_degree FROM x_rel")
def relationships_table(s: Star) -> DataFrame:
    return _relations(s)[2].select(F.col("r").cast("long").alias("r"), "source", "target", "description", "combined_degree")


@query(_REL + " SELECT c.id, title, upper(c.label) AS type, c.label || ' ' || title || '.' AS description, coalesce(degree, 0) AS degree FROM x_chosen c JOIN x_titles USING (label, id) LEFT JOIN x_deg ON x_deg.id = c.id")
def entities_table(s: Star) -> DataFrame:
    titled, c = units.titles(s.nodes).select("label", "id", "title"), _chosen(s).select("label", "id")
    return units.described(titled.join(c, ["label", "id"], "left_semi"), s.induced_degrees(c)).drop("label")


@query(_REL + """, x_sent AS (SELECT id_a AS id, r, description FROM x_rel UNION ALL SELECT id_b, r, description FROM x_rel)
SELECT c.id, coalesce(string_agg(description, ' ' ORDER BY r), '') AS text, coalesce(sum(len(regexp_extract_all(description, '\\S+'))), 0)::BIGINT AS n_tokens, count(r) AS n_relationships FROM x_chosen c LEFT JOIN x_sent x ON x.id = c.id GROUP BY c.id""")
def text_units(s: Star) -> DataFrame:
    """Each node's sentences as one text."""
    titled, _, rel = _relations(s)
    u = units.text_units(titled.join(_chosen(s).select("label", "id"), ["label", "id"], "left_semi"), rel)
    return u.select("id", "text", F.col("n_tokens").cast("long").alias("n_tokens"), F.size("relationship_ids").cast("long").alias("n_relationships"))


#: Texts of some nodes: of every part whose number a document bears, that document.
_OWN = r"""x_doc AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l, text FROM documents WHERE text IS NOT NULL),
x_ss AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM x_doc), x_sn AS (SELECT *, sum(len(regexp_extract_all(s, '[^ \t\n\r\f\v]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x_ss),
x_sf AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) FILTER (run <= 150) AS t FROM x_sn GROUP BY 1),
x_own AS (SELECT 'Gene' AS label, 'P' || doc_id AS id, coalesce(t, array_to_string(list_slice(regexp_extract_all(text, '[^ \t\n\r\f\v]+'), 1, 150), ' ')) AS own FROM x_sf JOIN x_doc USING (doc_id))"""


def _tables(s: Star) -> dict[str, DataFrame]:
    texts = s.table("documents").where("text IS NOT NULL").select(F.lit("Gene").alias("label"), F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("id"), "text")
    return units.unit_tables(_chosen(s), s.induced(_chosen(s)), texts)


_CHOSEN_TITLES = _TITLES.replace("FROM g_nodes)", "FROM g_nodes JOIN x_chosen USING (label, id))")
_REL_OWN = _REL.replace(_TITLES, _CHOSEN_TITLES)


@query(f"""{_REL_OWN}, {_OWN} SELECT 'e_' || c.id AS id, row_number() OVER (ORDER BY c.label, c.id) - 1 AS human_readable_id, title, upper(c.label) AS type, c.label || ' ' || title || '.' || coalesce(' ' || own, '') AS description,
't_' || c.id AS text_unit_ids, 1 AS frequency, coalesce(degree, 0) AS degree FROM x_chosen c JOIN x_titles USING (label, id) LEFT JOIN x_deg ON x_deg.id = c.id LEFT JOIN x_own o ON o.label = c.label AND o.id = c.id""")
def unit_entities(s: Star) -> DataFrame:
    """The table of entities, with texts of their own."""
    e = _tables(s)["entities"]
    return e.withColumn("text_unit_ids", F.array_join("text_unit_ids", ",")).withColumn("human_readable_id", F.col("human_readable_id").cast("long"))


@query(_REL_OWN + """ SELECT 'r' || r AS id, r AS human_readable_id, a AS source, b AS target, description, 1.0::DOUBLE AS weight, combined_degree, 't_' || id_a || ',t_' || id_b AS text_unit_ids FROM x_rel""")
def unit_relationships(s: Star) -> DataFrame:
    """The table of relationships."""
    r = _tables(s)["relationships"]
    return r.withColumn("text_unit_ids", F.array_join("text_unit_ids", ",")).withColumn("human_readable_id", F.col("human_readable_id").cast("long"))


@query(_REL_OWN + f""", {_OWN}, x_sent AS (SELECT id_a AS id, r, description FROM x_rel UNION ALL SELECT id_b, r, description FROM x_rel),
x_body AS (SELECT c.label, c.id, string_agg(description, ' ' ORDER BY r) AS body, string_agg('r' || r, ',' ORDER BY r) AS rels FROM x_chosen c LEFT JOIN x_sent x ON x.id = c.id GROUP BY 1, 2),
x_unit AS (SELECT b.label, b.id, concat_ws(' ', own, body) AS text, rels FROM x_body b LEFT JOIN x_own o ON o.label = b.label AND o.id = b.id)
SELECT 't_' || id AS id, row_number() OVER (ORDER BY label, id) - 1 AS human_readable_id, text, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS BIGINT) AS n_tokens, 'subgrafo' AS document_id, 'e_' || id AS entity_ids, coalesce(rels, '') AS relationship_ids, '' AS covariate_ids FROM x_unit""")
def unit_texts(s: Star) -> DataFrame:
    """The table of text units: a node's own text, cut, and the sentences of its edges."""
    u = _tables(s)["text_units"]
    for c in ("entity_ids", "relationship_ids", "covariate_ids"):
        u = u.withColumn(c, F.array_join(c, ","))
    return u.withColumn("human_readable_id", F.col("human_readable_id").cast("long")).withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query(r"""x_s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS i FROM documents),
x_n AS (SELECT *, sum(len(regexp_extract_all(s, '[^ \t\n\r\f\v]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x_s),
x_f AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) FILTER (run <= 60) AS t FROM x_n GROUP BY 1)
SELECT doc_id, coalesce(t, array_to_string(list_slice(regexp_extract_all(text, '[^ \t\n\r\f\v]+'), 1, 60), ' ')) AS short FROM x_f JOIN documents USING (doc_id)""")
def truncate_text(s: Star) -> DataFrame:
    """Whole sentences within a budget of words."""
    return s.table("documents").select("doc_id", X.shortened(F.col("text"), 60).alias("short"))


@query(r"""SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentences FROM documents""", graph=False)
def sentence_count(s: Star) -> DataFrame:
    return s.table("documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("sentences"))


def select_subgraph(s: Star, asked: DataFrame, method: str = "diamond_c3", rwr: bool = True, steps: dict[str, int] | None = None) -> DataFrame:
    """The selection of some entities, in the long form."""
    p = planes(s)
    nets = {k: expand.network(v) for k, v in p.items()}
    got = materialise(select.project_all(_edges(s), asked, p, nets, method=method, steps=steps), "selection")
    if not rwr:
        return got
    matrix = transition(s)
    return materialise(select.refine(got, matrix, rounds=ROUNDS, digits=10), "selection")


@query()
def query_subgraph(s: Star) -> DataFrame:
    """The whole path from entities to an induced, worded subgraph, for each configuration."""
    selection = select_subgraph(s, entities(s))
    out = None
    seen = materialise(select.ablation(selection).select("configuration", "label", "id").distinct(), "configured")
    for c in ("semillas", "diamond", "diamond_c3", "completa"):
        e = s.induced(seen.where(F.col("configuration") == c).select("label", "id"), named=True)
        one = e.select(F.lit(c).alias("configuration"), "label_a", "id_a", "label_b", "id_b", "type", X.sentence(F.col("type"), F.col("a"), F.col("label_a"), F.col("b")).alias("sentence"))
        out = one if out is None else out.unionByName(one)
    return out


def flagship(s: Star) -> DataFrame:
    """One supplier's subgraph as sentences: harvest, roles, growth by five, filter, induction."""
    asked = s.nodes.where("id = 'S1'").select("label", "id")
    selection = select_subgraph(s, asked, "diamond", rwr=False, steps=dict.fromkeys(STEPS, 5))
    chosen = select.configured(selection, "diamond")
    e = s.induced(chosen, named=True)
    return e.select("label_a", "id_a", "label_b", "id_b", "type", X.sentence(F.col("type"), F.col("a"), F.col("label_a"), F.col("b")).alias("sentence"))


