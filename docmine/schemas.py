"""Logical tables the operators work on."""

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


CLASS_LINES = _schema("value string")
PAGES = _schema("doc_id bigint, page_index int, text string")
LAYOUT_LINES = _schema(
    "doc_id bigint, page_index int, line_id int, text string, x0 double, y0 double, x1 double, y1 double"
)
LAYOUT_BLOCKS = _schema(
    "doc_id bigint, page_index int, block_id int, label string, content string, "
    "x0 double, y0 double, x1 double, y1 double"
)
COMPONENTS = _schema(
    "doc_id bigint, page_index int, comp_id int, w int, h int, area int, hull_area double"
)
REGIONS = _schema(
    "doc_id bigint, page_index int, region_id int, w int, h int, n_lines int, n_corners int"
)
NAMES = _schema("patent_no bigint, page int, iupac string")
STRUCTURES = _schema("mol_id bigint, smiles string, labels array<string>")
ATOMS = _schema(
    "mol_id bigint, idx int, symbol string, isotope int, charge int, explicit_h int, "
    "map_num int, x double, y double"
)
BONDS = _schema("mol_id bigint, u int, v int, code int")
SEQUENCES = _schema("seq_id bigint, ids array<int>")
EDGE_LOGITS = _schema("sample_id bigint, i int, j int, k int, logit double")
CANDIDATES = _schema(
    "image_id bigint, sample_id int, log_prob double, valid boolean, sim double, exact boolean"
)
PREDICTIONS = _schema("benchmark string, image_id bigint, mode string, smiles string")
TRUTH = _schema("benchmark string, image_id bigint, smiles string, ok boolean")
FINGERPRINTS = _schema("id bigint, bits array<int>")
