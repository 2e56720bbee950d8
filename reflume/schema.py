"""Row types of the engine's tables, as DDL."""

SOURCE = "struct<block_id: string, paragraph_index: int, start_offset: int, end_offset: int>"
ITEM = "struct<first_author: string, authors: array<string>, year: int, year_suffix: string, page: string, numbers: array<long>>"
KEYS = "struct<exact: string, bare: string, initials: string, given: string, others: array<struct<exact: string, bare: string>>>"
TOKEN = "struct<first: long, last: long, start: int, end: int>"
PERSON = "struct<original: string, family: string, given: string, exact: string, bare: string, initials: string>"

BLOCKS = "doc_id string, block_ord int, block_id string, type string, text string, style string, paragraph_index int, fields array<string>"
EXTRACTED = f"doc_id string, block_ord int, block_id string, paragraph_index int, kind string, start int, end int, raw string, family string, items array<{ITEM}>, keys array<{KEYS}>, tokens array<{TOKEN}>, confidence double, reason string, nth int"
ENTRIES = (
    f"doc_id string, entry_index int, block_id string, block_ord int, paragraph_index int, raw string, authors array<{PERSON}>, year int, year_suffix string, title string, "
    "container_title string, doi string, volume string, issue string, pages string, failure string, parse_confidence double"
)
SEVERITIES = ("ERROR", "WARNING", "AMBIGUOUS", "INFO")
STAGES = ("reading-document", "detecting-bibliography", "finding-citations", "matching-references", "running-checks")
