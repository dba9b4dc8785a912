"""Schemas of dump tables and of the engine's own tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


L, I, S, D, B = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType()

#: Raw dump tables, columns in file order.
DUMP = {
    "page": _struct(
        ("page_id", L), ("page_namespace", I), ("page_title", S), ("page_is_redirect", I), ("page_is_new", I), ("page_random", D),
        ("page_touched", S), ("page_links_updated", S), ("page_latest", L), ("page_len", L), ("page_content_model", S), ("page_lang", S),
    ),
    "pagelinks": _struct(("pl_from", L), ("pl_from_namespace", I), ("pl_target_id", L)),
    "linktarget": _struct(("lt_id", L), ("lt_namespace", I), ("lt_title", S)),
    "categorylinks": _struct(("cl_from", L), ("cl_to", S), ("cl_type", S)),
}

#: The engine's tables; page and link are partitioned by dump_date and wiki_name.
PAGE = _struct(("wiki_name", S), ("page_id", L), ("page_title", S), ("is_redirect", B))
LINK = _struct(("wiki_name", S), ("page_id", L), ("page_link", L))
CATEGORY = _struct(("wiki_name", S), ("page_id_from", L), ("category_name", S), ("category_type", S))
INFO = _struct(("wiki_name", S), ("dump_date", S), ("is_done", B), ("insertion_time_s", D), ("is_validated", B), ("num_pages_validated", I), ("validation_time_s", D))
BFS_TREE = _struct(("source_id", L), ("page_id", L), ("depth", I), ("previous_id", L))
TREE_STAT = _struct(("wiki_name", S), ("source_id", L), ("page_title", S), ("longest_path", T.ArrayType(S)), ("num_visited", L), ("depth_histogram", T.MapType(I, L)))
TASK = _struct(("name", S), ("dump_date", S), ("status", S), ("started_at", T.TimestampType()), ("finished_at", T.TimestampType()), ("message", S))
STAT = _struct(("dump_date", S), ("wiki_name", S), ("stat", S), ("value", L), ("page_id", L), ("page_title", S))
