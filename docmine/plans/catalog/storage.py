"""Round trips through files in the shared folder, and user functions over batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmine.functions import batch as B
from docmine.plans import derive as D
from docmine.plans.registry import query
from docmine.session import scratch_path
from docmine.sources import archives, store, text


@query("stored_key_list", "SELECT DISTINCT o_custkey::VARCHAR AS value FROM orders")
def stored_key_list(t):
    """Sorted key list written as text and read back."""
    path = scratch_path(t.spark, "keys")
    store.write_key_list(t.orders, "o_custkey", path)
    return t.spark.read.text(path)


@query("stored_by_source", "SELECT source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1")
def stored_by_source(t):
    """A CSV folder per source, read back with a declared schema."""
    path = scratch_path(t.spark, "by-source")
    store.write_by_key(t.documents.select("source", "doc_id", "lang"), "source", path)
    back = text.read_delimited(t.spark, path, "doc_id bigint, lang string, source string")
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("stored_rejects", "SELECT DISTINCT doc_id::VARCHAR AS value FROM labels WHERE quality = 0")
def stored_rejects(t):
    """Rejected keys of a batch; writing the batch twice leaves them once."""
    path = scratch_path(t.spark, "rejects")
    for _ in range(2):
        store.append_rejects(t.labels.filter("quality = 0"), "doc_id", path, 1)
    return t.spark.read.text(path).select("value")


@query("stored_structure_lines", f"WITH {D.STRUCTURES_SQL} SELECT smiles, mol_id::VARCHAR AS name FROM structures")
def stored_structure_lines(t):
    path = scratch_path(t.spark, "lines")
    store.write_structure_lines(D.structures(t.documents), path, "smiles", "mol_id")
    return text.read_structure_lines(t.spark, path)


@query("stored_records", "SELECT p_partkey::VARCHAR AS id, 'part ' || p_partkey || chr(10) || 'M  END' AS molblock FROM part")
def stored_records(t):
    """Records with properties written and read back."""
    path = scratch_path(t.spark, "sdf")
    block = F.concat(F.lit("part "), F.col("p_partkey"), F.lit("\nM  END"))
    props = F.create_map(F.lit("ID"), F.col("p_partkey").cast("string"), F.lit("NAME"), F.col("p_name"))
    store.write_sdf(t.part.select(block.alias("molblock"), props.alias("properties")), path)
    back = text.read_sdf(t.spark, path)
    return back.select(F.col("properties")["ID"].alias("id"), "molblock")


@query("stored_stage", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def stored_stage(t):
    """A stage built once and found again under the same parameters."""
    path = scratch_path(t.spark, "stage")
    n = t.documents.count()
    build = lambda: t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    store.reuse_or_build(t.spark, path, {"by": "lang"}, n, build)
    return store.reuse_or_build(t.spark, path, {"by": "lang"}, n, build)


@query("stored_metrics", "SELECT '{\"quality\":' || quality || ',\"n\":' || count(*) || '}' AS value FROM labels GROUP BY quality")
def stored_metrics(t):
    path = scratch_path(t.spark, "metrics")
    store.write_metrics(t.labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.text(path)


@query(
    "page_function",
    "SELECT doc_id, CASE WHEN lang = 'fr' THEN '' ELSE replace(text, 'e', '3') END AS text, CASE WHEN lang = 'fr' THEN 'not read: fr' END AS error FROM documents",
)
def page_function(t):
    """A user function per document; its failures are reported in the row."""

    def with_digits(value):
        lang, _, text = value.partition(":")
        if lang == "fr":
            raise ValueError("not read: fr")
        return text.replace("e", "3")

    pages = t.documents.select("doc_id", F.concat_ws(":", "lang", "text").alias("text"))
    return B.apply_per_page(pages, with_digits, "text", ["doc_id"])


@query("batch_lengths", "SELECT doc_id, length(text)::BIGINT AS result, true AS success, NULL::VARCHAR AS error FROM documents")
def batch_lengths(t):
    """A model stand-in loaded once per task and called on chunks."""
    slim = t.documents.select("doc_id", "text")
    return B.batch_infer(slim, lambda: len, lambda model, values: [model(v) for v in values], "text", "doc_id", "bigint")


@query("batch_counters", "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1")
def batch_counters(t):
    """User counters per batch, merged by built-in aggregates."""
    return B.reduce_partials(
        t.events.select("event_type", "event_id"), ["event_type"],
        lambda part: {"n": len(part), "last_id": int(part["event_id"].max())},
        {"n": "sum", "last_id": "max"}, "n bigint, last_id bigint",
    )


ARCHIVED_SQL = "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS sha FROM documents"


@query("archived_documents", f"{ARCHIVED_SQL} WHERE doc_id IN (SELECT doc_id FROM labels)")
def archived_documents(t):
    """Documents written into tar and zip archives beside other members; those on a key list
    are found by the archives' directories and read from their places."""
    path = scratch_path(t.spark, "archives")
    stem = F.col("doc_id").cast("string")
    # An archive holds a bounded run of ids, whatever their source.
    box = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 4096).cast("string"))
    name = F.concat(box, F.when(F.crc32(box) % 2 == 0, ".tar").otherwise(".zip"))
    rows = t.documents.select(name.alias("archive"), stem.alias("stem"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    texts = rows.select("archive", F.concat(F.lit("texts/"), "stem", F.lit(".TXT")).alias("member"), "content")
    other = rows.select("archive", F.concat(F.lit("notes/"), "stem", F.lit(".md")).alias("member"), F.lit(b"-").alias("content"))
    archives.write_archives(texts.unionByName(other), path)
    keys = t.labels.select(F.col("doc_id").cast("string").alias("stem"))
    found = archives.read_archive_members(t.spark, path, ".txt", keys)
    return found.select(F.col("stem").cast("bigint").alias("doc_id"), F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("sha"))
