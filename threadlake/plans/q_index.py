"""Queries: media index."""

from __future__ import annotations

from threadlake.operators import index as ix
from threadlake.plans import bindings as b
from threadlake.plans.catalog import register


def _index(spark, sf):
    return ix.build_index(b.index_media(spark, sf))


@register("file_index")
def q_file_index(spark, sf):
    return _index(spark, sf)


@register("duplicate_lookup")
def q_duplicate_lookup(spark, sf):
    return ix.lookup_duplicates(b.candidates(spark, sf), _index(spark, sf)).select(
        "cand_id", "ext", "size_mb", "md5_b64", "n_copies", "first_path", "is_new")


@register("novel_files")
def q_novel_files(spark, sf):
    return ix.novel(b.candidates(spark, sf), _index(spark, sf)).select(
        "cand_id", "ext", "size_mb", "md5_b64", "is_new")


@register("duplicate_groups")
def q_duplicate_groups(spark, sf):
    return ix.duplicate_groups(_index(spark, sf))


@register("bucket_stats")
def q_bucket_stats(spark, sf):
    return ix.bucket_stats(_index(spark, sf))


@register("bucket_occupancy")
def q_bucket_occupancy(spark, sf):
    return ix.bucket_occupancy(_index(spark, sf))


@register("index_dirs")
def q_index_dirs(spark, sf):
    return ix.index_directories(_index(spark, sf))


@register("complete_dirs")
def q_complete_dirs(spark, sf):
    return ix.complete_dirs(ix.index_directories(_index(spark, sf)), "src1")


@register("scan_media")
def q_scan_media(spark, sf):
    """S2 over the input folder itself: its parquet files are the media."""
    from threadlake.sources.media import list_media, scan_media

    return scan_media(spark, sf, exts=("parquet",), listing=list_media(spark, sf))


@register("scan_again")
def q_scan_again(spark, sf):
    """S2 over a folder that was scanned before: digests of unchanged files come from that scan."""
    from threadlake.sources.materialize import materialize
    from threadlake.sources.media import SCAN_DDL, scan_changes

    none = spark.createDataFrame([], SCAN_DDL)
    before = materialize(spark, lambda: scan_changes(spark, sf, none, exts=("parquet",))[0], "scan", f"{b.code_tag()}|{sf}")
    return scan_changes(spark, sf, before, exts=("parquet",))[0].drop("modified")


@register("index_nested")
def q_index_nested(spark, sf):
    """The index written in the archive's nested layout and read back from its lines."""
    import uuid

    from threadlake.sources.index_store import load_index_nested, save_index_nested
    from threadlake.sources.materialize import table_path

    path = table_path(spark, f"index-nested-{uuid.uuid4().hex}", sf)
    save_index_nested(_index(spark, sf), path)
    return load_index_nested(spark, path)


@register("index_roundtrip")
def q_index_roundtrip(spark, sf):
    """Write the index as Parquet partitioned by ext, read it back."""
    import uuid

    from threadlake.sources.index_store import load_index, save_index
    from threadlake.sources.materialize import table_path

    path = table_path(spark, f"index-snapshot-{uuid.uuid4().hex}", sf)
    save_index(_index(spark, sf), path)
    return load_index(spark, path)


@register("index_json")
def q_index_json(spark, sf):
    """The index as sorted-key JSON lines."""
    from threadlake.sources.index_store import index_json_lines

    return index_json_lines(_index(spark, sf))
