"""Schemas of the tables; missing geometry is 0.0, not null."""

SPANS = (
    "doc_id bigint, page_no int, line_no int, span_no int, source string, text string, size double, font string, "
    "x0 double, top double, x1 double, bottom double"
)
PAGES = "doc_id bigint, page_no int, width double, height double, text_chars int"
SEGMENTS = "doc_id bigint, page_no int, seg_no int, loc int, len int, text string, x0 double, x1 double, y0 double, y1 double"
BLOCKS = "doc_id bigint, block_no int, kind string, level int, page_no int, text string, first_line_indent_em double, space_before_em double"
OUTLINE = "doc_id bigint, entry_no int, level int, title string, chapter_no int, anchor string, parent_no int"
FONTS = "path string, family string, coverage int, probe int, license_text string"
