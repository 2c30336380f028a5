"""Schemas of the tables that the steps exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LINK = _struct(title=_S, text=_S, start=_I, end=_I)
RAW_PAGES = _struct(title=_S, lang=_S, wiki_text=_S, redirect=_S)
PARAGRAPHS = _struct(title=_S, para_no=_I, text=_S, wiki_links=T.ArrayType(LINK), abstract=_B)
PAGES = _struct(title=_S, is_disambiguation=_B)
REDIRECTS = _struct(src=_S, dst=_S)
TOKENS = _struct(pos=_I, token=_S, start=_I, end=_I)
WORDS = _struct(idx=_I, text=_S, count=_L, doc_count=_L)
ENTITIES = _struct(idx=_I, title=_S, count=_L, doc_count=_L)
REDIRECT_IDX = _struct(src=_S, entity_idx=_I)
EDGES = _struct(src=_I, dst=_I)
MENTIONS = _struct(name=_S, entity_idx=_I, link_count=_L, total_link_count=_L, doc_count=_L)
VECTORS = _struct(idx=_I, syn0=T.ArrayType(T.FloatType()), syn1=T.ArrayType(T.FloatType()))
#: One ``page`` element of a dump; ``text`` carries an attribute, so it is a struct.
DUMP_PAGE = _struct(
    title=_S,
    ns=_S,
    redirect=_struct(_title=_S, _VALUE=_S),
    revision=_struct(text=_struct(_VALUE=_S)),
)
