"""Record types and registries of the heterogeneous graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()  # noqa: E741

NODE = _struct(label=S, id=S, name=S, source=S, is_group=B)
EDGE = _struct(type=S, label_a=S, id_a=S, label_b=S, id_b=S, weight=D, origin=S)
RAW_NODE = _struct(node_index=L, node_id=S, node_name=S, node_type=S, node_source=S)
RAW_EDGE = _struct(x_index=L, y_index=L, x_id=S, y_id=S, x_type=S, y_type=S, edge_type=S, edge_source=S)
ENTITY = _struct(label=S, id=S)
PROVENANCE = _struct(entity=ENTITY, step=S, role=S, iteration=I, p_value=D, method=S)
SUBGRAPH_NODE = _struct(label=S, id=S, name=S, provenances=T.ArrayType(PROVENANCE))
SUBGRAPH_EDGE = _struct(label_a=S, id_a=S, label_b=S, id_b=S, type=S, properties=T.MapType(S, S))
MENTION = _struct(mentions=T.ArrayType(_struct(text=S, kind=S, english=S)))
RESPONSE = _struct(question=S, answer=S, code=I, seconds=D)
REPORT = T.StructType(
    [T.StructField(c, T.StringType()) for c in "id human_readable_id community level parent title summary full_content rank rating_explanation findings full_content_json period size children".split()]
)

#: Roles of a node in a selection.
ENTITY_ROLE, SEED, OUTSIDE, ADDED = "entidad", "semilla", "vecino_fuera_del_plano", "agregado"
#: Methods that a configuration lets add nodes.
CONFIGURATIONS = {"semillas": (), "diamond": ("diamond",), "diamond_c3": ("diamond", "c3"), "completa": ("diamond", "c3", "rwr")}
#: Labels and the planes that they have.
PLANE_OF = {"Gene": "gene", "Disease": "disease", "Drug": "drug"}
#: Iterations of the module growth in each step, and seeds that it needs.
K_PER_STEP = {"disease_a_gene": 40, "drug_a_gene": 10, "gene_a_disease": 50, "drug_a_disease": 30, "disease_a_drug": 25, "gene_a_drug": 10}
MIN_SEEDS = 5
#: Nodes that the random walk adds for each type, its restart and its share of jumps.
K_PER_TYPE = {"Gene": 9, "Disease": 8, "Drug": 8}
RESTART, JUMP = 0.5, 1 / 3
#: Edge type to relation.
RELATION_OF = {"ppi": "PPI", "gda": "GDA", "pathway_protein": "PATHWAY_PROTEIN", "form_complex": "FORM_COMPLEX", "disease_disease": "DISEASE_DISEASE", "indication": "INDICATION", "drug_gene": "DRUG_TARGET", "drug_drug": "DRUG_DRUG"}


@dataclass(frozen=True)
class Plane:
    """A homogeneous network: nodes of one label joined by some relations."""

    name: str
    label: str
    relations: tuple[str, ...]
    without_groups: bool = False
    least_weight: float | None = None


@dataclass(frozen=True)
class Step:
    """From entities of one label to the plane of another through a relation."""

    name: str
    origin: str
    plane: str
    relation: str

    @property
    def target(self) -> str:
        return next(k for k, v in PLANE_OF.items() if v == self.plane)


PLANES = {
    "gene": Plane("gene", "Gene", ("PPI",)),
    "disease": Plane("disease", "Disease", ("DISEASE_DISEASE",), without_groups=True),
    "drug": Plane("drug", "Drug", ("DRUG_DRUG",)),
}
STEPS = {
    s.name: s
    for s in (
        Step("disease_a_gene", "Disease", "gene", "GDA"),
        Step("gene_a_disease", "Gene", "disease", "GDA"),
        Step("drug_a_gene", "Drug", "gene", "DRUG_TARGET"),
        Step("drug_a_disease", "Drug", "disease", "INDICATION"),
        Step("disease_a_drug", "Disease", "drug", "INDICATION"),
        Step("gene_a_drug", "Gene", "drug", "DRUG_TARGET"),
    )
}


def drug_plane(threshold: float, lowest: float = 0.8) -> Plane:
    """The drug plane of similarities from threshold up; its name tells the threshold."""
    if not lowest <= threshold <= 1:
        raise ValueError(f"a threshold between {lowest} and 1 is needed")
    return Plane(f"drug_u{round(threshold * 100):03d}", "Drug", ("DRUG_DRUG",), least_weight=threshold)


def disease_plane(with_groups: bool = False) -> Plane:
    return Plane("disease", "Disease", ("DISEASE_DISEASE", "DISEASE_BERT") if with_groups else ("DISEASE_DISEASE",), without_groups=not with_groups)
