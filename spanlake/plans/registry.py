"""Registration of queries with their SQL twins, and SQL fragments that several share."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


#: documents as files and lines, with an empty last line left out
FILES_SQL = """files as (select doc_id, 'src/' || coalesce(source, 'none') || '/' || doc_id || '.' ||
    case lang when 'en' then 'py' when 'fr' then 'java' when 'de' then 'md' when 'es' then 'dat' else 'txt' end as path,
    coalesce(text, '') as body, strlen(coalesce(text, '')) as size, source as module from documents)"""
LINES_SQL = (
    FILES_SQL
    + """, parts as (select doc_id, string_split(body, chr(10)) as p from files),
    cut as (select doc_id, case when p[len(p)] = '' then p[1:len(p) - 1] else p end as p from parts),
    lines as (select doc_id, unnest(range(1, len(p) + 1))::int as line, regexp_replace(unnest(p), '\\r$', '') as text from cut)"""
)
SYMBOLS_SQL = (
    LINES_SQL
    + """, symbols as (select regexp_extract(l.text, '^[ \\t]*([A-Za-z_][A-Za-z0-9_]*)', 1) as name, 'head' as kind, l.doc_id as file, l.line,
    sha256(f.body) as content_hash, 'line-head' as provenance, 0.9::double as confidence
    from lines l join files f using (doc_id) where regexp_matches(l.text, '^[ \\t]*[A-Za-z_][A-Za-z0-9_]*'))"""
)


def corpus(spark, sf_dir):
    """files, lines and symbols of the documents table."""
    from pyspark.sql import functions as F

    from spanlake.functions import text as T
    from spanlake.operators.index import symbols
    from spanlake.sources.corpus import document_files, line_scan, table

    files = document_files(table(spark, sf_dir, "documents"))
    lines = line_scan(files)
    hashed = files.select(F.col("doc_id").alias("file"), "body", T.content_hash(F.col("body")).alias("content_hash"))
    return files, lines, symbols(line_scan(hashed, "file", keep=("content_hash",)))


def fulltext_index(spark, sf_dir):
    """The stored inverted index of the documents table."""
    from spanlake.operators import fulltext
    from spanlake.sources.corpus import stored, table

    source = f"{sf_dir}/documents.parquet"
    return stored(spark, "fulltext", source, lambda path: fulltext.write(fulltext.postings(table(spark, sf_dir, "documents")), path))
