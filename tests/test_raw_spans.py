"""Spans of given chunks count the raw characters of texts with CRLF."""

from spanforge.operators import chunking as C
from spanforge.operators import index as X

TEXT = "intro\r\n# One\r\nalpha\r\n# Two\r\nomega"
DOCS = [(1, "a.md", TEXT)]


def frames(spark):
    two, end = TEXT.index("# Two"), len(TEXT)
    spans = [(1, 0, 7), (2, 7, two), (3, two - 1, end), (4, two, end), (5, 0, end + 1)]
    chunks = [(i, 1, "a.md", a, b, None) for i, a, b in spans]
    return (
        spark.createDataFrame(chunks, "chunk_id long, doc_id long, file_path string, first_character_index long, last_character_index long, chunked_at timestamp"),
        spark.createDataFrame(DOCS, "doc_id long, file_path string, text string"),
    )


def test_last_chunk_of_a_crlf_text_is_kept(spark):
    got = {r.chunk_id: (r.first, r.last, r.text) for r in X.current_chunks(*frames(spark)).collect()}
    two, end = TEXT.index("# Two"), len(TEXT)
    assert got == {1: (0, 7, "intro\n"), 2: (7, two, "# One\nalpha\n"), 3: (two - 1, end, "\n# Two\nomega"), 4: (two, end, "# Two\nomega")}


def test_headers_are_in_the_same_coordinates(spark):
    chunks, docs = frames(spark)
    rows = X.header_context(X.current_chunks(chunks, docs, line_first=True), C.headers(docs), first="line_first")
    assert {r.chunk_id: r.context for r in rows.collect()} == {1: None, 2: "One", 3: "One", 4: "One Two"}
