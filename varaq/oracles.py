"""The same results in DuckDB's SQL, written on their own: joins, windows and recursion instead of folds."""

from __future__ import annotations

import unicodedata

# Fixed values, written out for these checks: characters, words, names and patterns that the rules are about.
_BOLD_FILE = "(?i)(^|[^a-z])(bd|bold|black|heavy|semibold|demibold)([^a-z]|$)"
_ITALIC_FILE = "(?i)(italic|oblique|it([^A-Za-z0-9_]|$))"
_NOT_REGULAR = "(?i)(light|thin|ultra|black|medium|heavy|semi|demi|bd|bold)"
_OPEN_LICENCES = (
    "sil open font license", "open font license", "scripts.sil.org/ofl", "openfontlicense", "apache license, version 2.0",
    "apache.org/licenses/license-2.0",
)
_PREFERRED = (
    "vazirmatn", "vazir", "iransans", "iranyekan", "yekan bakh", "sahel", "shabnam", "samim", "tanha", "gandom", "parastoo", "estedad", "dana",
    "peyda", "morabba", "mikhak", "shahab", "bnazanin", "inazanin", "nazanin", "bmitra", "imitra", "mitra", "btitr", "titr", "amiri",
    "noto naskh arabic", "noto sans arabic", "scheherazade", "markazi text", "kalameh", "dubai",
)
_ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
_ASCII_DIGITS = "0123456789"
_BIDI_CONTROLS = '\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\ufeff'
_EDITION_WORDS = ("نسخه", "نسخهٔ", "ویرایش", "چاپ")
_FOLD_FROM = "يىكةۀے"
_FOLD_TO = "ییکههی"
_FOLIO = "^[۰-۹0-9]{1,4}$"
_FUNCTION_WORDS = (
    "و", "در", "به", "از", "که", "این", "را", "با", "برای", "است", "یک", "آن", "تا", "هم", "بود", "شد", "بر", "خود", "او", "ما", "شما", "ولی", "اما",
    "یا", "اگر", "چون", "همه", "هر", "دو", "سه", "نیز", "بی", "چند", "روی",
)
_HEADING_WORDS = ("فصل", "بخش", "گفتار", "دفتر", "پیشگفتار", "پیش\u200cگفتار", "مقدمه", "دیباچه", "ضمیمه", "کتابنامه", "منابع", "نمایه", "پیوست", "نتیجه")
_HEADINGS = (
    "^(?:" + "|".join(_HEADING_WORDS) + ")([^\\p{L}\\p{N}_]|$)", "^[۰-۹0-9]+[.\u200c\\-–][\\s\\p{Z}]*[^۰-۹0-9]", "^[۰-۹0-9]+([.][۰-۹0-9]+)+[\\s\\p{Z}]",
    "^[۰-۹0-9]+[)][\\s\\p{Z}]", "^[IVXLC]+[.][\\s\\p{Z}]",
)
_LETTERS = "ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیءآأإئؤة۰۱۲۳۴۵۶۷۸۹"
_MARKS = "ً-ٰٕ"
_PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
_PREFIX_EXCEPTIONS = (
    "میان", "میز", "میزان", "میلی", "میلیون", "میلیارد", "مینا", "میرا", "میراث", "میوه", "میکا", "میکرب", "میکروسکوپ", "میگو", "میدان", "میل",
    "میله", "میم", "مینی", "میهن", "میخ", "میر", "میزبان", "میکرو", "میانگین", "میانسال", "نمیان", "میزنم",
)
_PRESENTATION_RANGES = ((0xfb50, 0xfdff), (0xfe70, 0xfeff))
_TATWEEL = "ـ"
_TYPOGRAPHY_FROM = ",;?"
_TYPOGRAPHY_TO = "،؛؟"
_ZWJ = '\u200d'

WS = "[\\s\\x{0b}\\x{85}\\p{Z}]"
_K = "doc_id, page_no, line_no, span_no"


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(**columns: str) -> str:
    return f"SELECT DISTINCT {_K}, " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + " FROM spans WHERE text IS NOT NULL"


def _translate(t: str, a: str, b: str) -> str:
    return f"translate({t}, {_s(a)}, {_s(b)})"


def _replace(t: str, pattern: str, by: str) -> str:
    return f"regexp_replace({t}, {_s(pattern)}, {_s(by)}, 'g')"


def _strip(t: str) -> str:
    return _replace(t, f"^{WS}+|{WS}+$", "")


def _clean(t: str) -> str:
    return _strip(_replace(t, "[ \\t]+", " "))


def _chars(t: str) -> str:
    """The code points of a text, in order."""
    return f"regexp_extract_all({t}, '(?s).')"


def _forms(t: str) -> str:
    """Presentation forms, by the map that Unicode gives."""
    pairs = {chr(c): unicodedata.normalize("NFKC", chr(c)) for a, b in _PRESENTATION_RANGES for c in range(a, b + 1)}
    pairs = {k: v for k, v in pairs.items() if k != v}
    keys, values = ", ".join(map(_s, pairs)), ", ".join(map(_s, pairs.values()))
    known = f"map([{keys}], [{values}])"
    return f"CASE WHEN regexp_matches({t}, '[\\x{{fb50}}-\\x{{fdff}}\\x{{fe70}}-\\x{{feff}}]') THEN array_to_string(list_transform({_chars(t)}, lambda c: coalesce({known}[c], c)), '') ELSE {t} END"


def _backwards(t: str) -> str:
    return f"array_to_string(list_reverse({_chars(t)}), '')"


_RUN = "([A-Za-z0-9._\\-@:/]+|[^A-Za-z0-9._\\-@:/])"


def _unmirror(t: str) -> str:
    line = f"array_to_string(list_transform(regexp_extract_all({_backwards('l')}, {_s('(?s)' + _RUN)}), lambda x: {_backwards('x')}), '')"
    return f"array_to_string(list_transform(string_split({t}, chr(10)), lambda l: {line}), chr(10))"


def _mirrored(t: str) -> str:
    words = f"list_filter(regexp_split_to_array({t}, {_s(WS + '+')}), lambda w: regexp_full_match(w, '\\p{{L}}+'))"
    known = "[" + ", ".join(map(_s, _FUNCTION_WORDS)) + "]"
    return (
        f"(SELECT len(w) >= 30 AND b > 0 AND f < b * 1.6 FROM (SELECT w, len(list_filter(w, lambda x: list_contains({known}, x))) AS f, "
        f"len(list_filter(w, lambda x: list_contains({known}, {_backwards('x')}))) AS b FROM (SELECT {words} AS w)))"
    )


def _brackets(t: str, count: bool = False) -> str:
    """Word by word."""
    parts = f"regexp_extract_all({t}, {_s('(?s)[^' + WS[1:] + '+|' + WS + '+')})"
    bad = "length(w) >= 3 AND left(w, 1) || right(w, 1) IN (')(', '][', '}{')"
    if count:
        return f"len(list_filter({parts}, lambda w: {bad}))::INTEGER"
    return f"array_to_string(list_transform({parts}, lambda w: CASE WHEN {bad} THEN right(w, 1) || substr(w, 2, length(w) - 2) || left(w, 1) ELSE w END), '')"


def _marks(t: str) -> str:
    m = _MARKS
    kept = f"regexp_replace({t}, '([^\\s\\x{{0b}}\\x{{85}}\\p{{Z}} A-Za-z{m}])( ?)([{m}])', '\\1\ue000\\3\\2', 'g')"
    return f"replace(regexp_replace({kept}, '(\ue000[{m}])|[{m}]', '\\1', 'g'), '\ue000', '')"


_P = "«»()\\[\\]{}،؛؟!.:"


def _zwnj(t: str) -> str:
    """Character by character, with both neighbours at hand."""
    once = f"replace(replace({t}, '\u200c\u200c', '\u200c'), '\u200d', '')"
    cs = f"[''] || {_chars(once)} || ['']"
    edge = f"regexp_full_match(%s, '[\\s\\x{{0b}}\\x{{85}}\\p{{Z}}{_P}]?')"
    kept = f"(SELECT array_to_string(list_transform(generate_series(2, len(c) - 1), lambda i: CASE WHEN c[i] = '\u200c' AND ({edge % 'c[i - 1]'} OR {edge % 'c[i + 1]'}) THEN '' ELSE c[i] END), '') FROM (SELECT {cs} AS c))"
    return f"regexp_replace({kept}, '^\u200c+|\u200c+$', '', 'g')"


def _prefixes(t: str) -> str:
    core = f"regexp_replace(w, '^[{_P}]+|[{_P}]+$', '', 'g')"
    words = ", ".join(map(_s, _PREFIX_EXCEPTIONS))
    glued = f"regexp_matches({core}, '^(نمی|می)[{_LETTERS}](?s:.)') AND NOT contains({core}, '\u200c') AND {core} NOT IN ({words})"
    return f"array_to_string(list_transform(string_split({t}, ' '), lambda w: CASE WHEN {glued} THEN regexp_replace(w, '^([{_P}]*)(نمی|می)', '\\1\\2\u200c') ELSE w END), ' ')"


_BLANK = "[\\t\\x{0b}\\f\\r\\x{85}\\p{Z}]+"


def _lines(t: str) -> str:
    a = f"regexp_replace(translate({t}, '\u00a0\u200b', ' '), '{_BLANK}', ' ', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({a}, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^ | $', '', 'g')"


def _fragment(t: str) -> str:
    return f"regexp_replace({t}, '{_BLANK}', ' ', 'g')"


def _joints(t: str, what: str = "\u200c") -> str:
    return f"length(regexp_replace({t}, '[^{what}]', '', 'g'))"


_NORMAL = f"""
    s0 AS (SELECT DISTINCT {_K}, text FROM spans WHERE text IS NOT NULL),
    s1 AS (SELECT {_K}, {_forms(_translate('text', _BIDI_CONTROLS + _ZWJ, ''))} AS t FROM s0),
    s2 AS (SELECT {_K}, {_translate('t', _FOLD_FROM + _ARABIC_DIGITS + _TATWEEL, _FOLD_TO + _PERSIAN_DIGITS)} AS t FROM s1),
    s3 AS (SELECT {_K}, t AS t0, {_mirrored('t')} AS mirrored FROM s2),
    s4 AS (SELECT {_K}, mirrored, CASE WHEN mirrored THEN {_unmirror('t0')} ELSE t0 END AS t FROM s3),
    s5 AS (SELECT {_K}, mirrored, {_brackets('t', True)} AS brackets_repaired, {_brackets('t')} AS t FROM s4),
    s6 AS (SELECT {_K}, mirrored, brackets_repaired, t AS b, {_marks('t')} AS t FROM s5),
    s7 AS (SELECT {_K}, mirrored, brackets_repaired, ({_joints('b', _MARKS)} - {_joints('t', _MARKS)})::INTEGER AS marks_removed, t AS b, {_zwnj('t')} AS t FROM s6),
    s8 AS (SELECT {_K}, mirrored, brackets_repaired, marks_removed, ({_joints('b')} - {_joints('t')})::INTEGER AS zwnj_removed, t AS b, {_prefixes('t')} AS t FROM s7),
    normal AS (SELECT {_K}, mirrored, brackets_repaired, marks_removed, zwnj_removed, ({_joints('t')} - {_joints('b')})::INTEGER AS zwnj_added, {_fragment('t')} AS text FROM s8)"""

def _heading(t: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({t}, {_s(p)})" for p in _HEADINGS) + ")"


#: Lines, sizes and classes, as common table expressions.
_LINES = f"""
    sp AS (SELECT DISTINCT doc_id, page_no, line_no, span_no, coalesce(text, '') AS text, size, font, x0, top, x1, bottom FROM spans),
    by_size AS (SELECT doc_id, page_no, line_no, round(size, 1) AS s, sum(length(text)) AS n, min(span_no) AS f FROM sp GROUP BY ALL),
    sized AS (SELECT doc_id, page_no, line_no, s AS size FROM by_size QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, line_no ORDER BY n DESC, f) = 1),
    dom AS (SELECT doc_id, page_no, line_no, coalesce(regexp_matches(font, '(?i)bold|black|heavy|semibold|demi'), false) AS bold, coalesce(regexp_matches(font, '(?i)italic|oblique'), false) AS italic
            FROM sp QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, line_no ORDER BY length(text) DESC, span_no) = 1),
    joined AS (SELECT doc_id, page_no, line_no, string_agg(text, '' ORDER BY span_no) AS text, sum(length(text))::INTEGER AS chars, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM sp GROUP BY ALL),
    ln AS (SELECT joined.*, sized.size, dom.bold, dom.italic FROM joined JOIN sized USING (doc_id, page_no, line_no) JOIN dom USING (doc_id, page_no, line_no)),
    pg AS (SELECT doc_id, page_no, max(width) AS width, max(height) AS height FROM pages_geom GROUP BY ALL)"""
_BODY = """
    hist AS (SELECT doc_id, size, sum(chars)::BIGINT AS chars, min(page_no * 1000000 + line_no) AS first FROM ln GROUP BY ALL),
    bd AS (SELECT doc_id, size AS body FROM hist QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first) = 1)"""
_TIERS = """
    big AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS r FROM hist JOIN bd USING (doc_id) WHERE size >= body * 1.12 AND chars >= 8),
    walk AS (SELECT doc_id, r, [size] AS kept FROM big WHERE r = 1 UNION ALL
             SELECT big.doc_id, big.r, CASE WHEN abs(walk.kept[-1] - big.size) <= 0.6 THEN walk.kept ELSE walk.kept || [big.size] END FROM walk JOIN big ON big.doc_id = walk.doc_id AND big.r = walk.r + 1),
    tr AS (SELECT doc_id, kept[1:3] AS tiers FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) = 1)"""
_HEADS = f"""
    st AS (SELECT *, {_strip('text')} AS stripped FROM ln),
    np AS (SELECT doc_id, count(*) AS pages FROM pg GROUP BY ALL),
    rh AS (SELECT doc_id, stripped AS text, count(DISTINCT page_no) AS on_pages FROM st LEFT JOIN np USING (doc_id) WHERE length(stripped) BETWEEN 1 AND 60
           GROUP BY doc_id, stripped, pages HAVING count(DISTINCT page_no) >= greatest(2, least(3, greatest(1, coalesce(pages, 1)) // 3)) AND (regexp_matches(stripped, {_s(_FOLIO)}) OR length(stripped) > 3))"""
_LEADING = """
    gaps AS (SELECT doc_id, page_no, size, lead(size) OVER w AS nxt, greatest(0.0, lead(top) OVER w - bottom) AS gap, lead(top) OVER w AS t2 FROM ln WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)),
    mg AS (SELECT doc_id, page_no, list_sort(list(gap))[count(*) // 2 + 1] AS median_gap FROM gaps WHERE t2 IS NOT NULL AND gap <= greatest(size, nxt) * 1.25 GROUP BY ALL),
    re AS (SELECT doc_id, page_no, list_sort(list(x1))[least(count(*), floor(count(*) * 0.75)::BIGINT + 1)] AS right_edge FROM ln JOIN bd USING (doc_id) WHERE x1 > x0 AND abs(size - body) <= greatest(0.6, body * 0.08) GROUP BY ALL)"""
_CLASSES = f"""
    cl AS (SELECT st.*, coalesce(height, 0.0) AS height, body, coalesce(tiers, []) AS tiers, coalesce(median_gap, 0.0) AS median_gap, coalesce(right_edge, 0.0) AS right_edge,
             CASE WHEN stripped = '' THEN 'blank' WHEN rh.text IS NOT NULL THEN 'running' WHEN regexp_matches(stripped, {_s(_FOLIO)}) AND top > coalesce(height, 0.0) * 0.85 THEN 'folio'
                  WHEN size <= body * 0.94 AND top >= coalesce(height, 0.0) * 0.55 THEN 'note'
                  WHEN chars <= 200 AND (size >= body * 1.12 OR (NOT regexp_matches(stripped, '^[۰-۹0-9. ]+$') AND {_heading('stripped')})) THEN 'heading' ELSE 'body' END AS class
           FROM st LEFT JOIN pg USING (doc_id, page_no) LEFT JOIN bd USING (doc_id) LEFT JOIN tr USING (doc_id) LEFT JOIN mg USING (doc_id, page_no) LEFT JOIN re USING (doc_id, page_no)
           LEFT JOIN rh ON rh.doc_id = st.doc_id AND rh.text = st.stripped),
    lv AS (SELECT *, CASE WHEN class <> 'heading' THEN 0 WHEN size >= body * 1.12 THEN coalesce(nullif(list_position(list_transform(tiers, lambda t: abs(size - t) < 0.05), true), 0), 3) ELSE 3 END::INTEGER AS level FROM cl)"""


def _em(points: str, least_: str, void: str) -> str:
    return f"CASE WHEN {void} OR {points} < {least_} THEN 0.0::DOUBLE ELSE least(3.0, round({points} / body, 2)) END"


def _indent(x1: str) -> str:
    return _em(f"greatest(0.0, right_edge - {x1})", "greatest(4.0, body * 0.5)", f"right_edge = 0 OR body IS NULL OR body = 0 OR {x1} = 0")


def _block_rules(keep: bool) -> str:
    live = "(pc = 'body'" + (" OR pc = 'note')" if keep else ")")
    return f"""
    seq AS (SELECT *, lag(class) OVER w AS pc, lag(page_no) OVER w AS pp, lag(bottom) OVER w AS pb, lag(x1) OVER w AS px FROM lv WHERE class IN ('note', 'heading', 'body') WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, line_no)),
    liv AS (SELECT *, coalesce({live}, false) AS live, CASE WHEN coalesce({live}, false) THEN greatest(0.0, top - pb) END AS gap FROM seq),
    ind AS (SELECT *, {_indent('x1')} AS indent, CASE WHEN live THEN {_indent('px')} ELSE 0.0 END AS pindent,
              {_em('greatest(0.0, gap - median_gap)', 'greatest(2.0, body * 0.2)', 'gap IS NULL OR body IS NULL OR body = 0')} AS space FROM liv),
    opn AS (SELECT *, CASE WHEN class = 'heading' THEN true
                           WHEN class = 'note' THEN {'NOT live OR pc <> ' + _s('note') + ' OR pp <> page_no' if keep else 'false'}
                           ELSE NOT live OR pc <> 'body' OR gap > greatest(2.0, median_gap * 1.6) OR (indent > 0 AND pindent = 0) END AS opens FROM ind),
    num AS (SELECT *, (sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY page_no, line_no ROWS UNBOUNDED PRECEDING) - 1)::INTEGER AS block_no,
              CASE class WHEN 'heading' THEN 'h' || level WHEN 'note' THEN 'note' ELSE 'p' END AS kind FROM opn)"""


_ALL = f"WITH RECURSIVE {_LINES}, {_BODY}, {_TIERS}, {_HEADS}, {_LEADING}, {_CLASSES}"
_SEGMENTS = f"""WITH RECURSIVE {_LINES},
    sg AS (SELECT doc_id, page_no, (row_number() OVER w - 1)::INTEGER AS seg_no, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, page_no ORDER BY line_no, span_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS loc,
             length(text)::INTEGER AS len, text, font, size, x0, x1, height - bottom AS y0, height - top AS y1 FROM sp JOIN pg USING (doc_id, page_no) WHERE text <> '' WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no, span_no))"""
_BANDS = _SEGMENTS + """,
    srt AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY -y1, seg_no) AS r FROM sg),
    fold AS (SELECT doc_id, page_no, r, seg_no, 0 AS band, -y1 AS anchor FROM srt WHERE r = 1 UNION ALL
             SELECT s.doc_id, s.page_no, s.r, s.seg_no, CASE WHEN -s.y1 - f.anchor > 4.0 THEN f.band + 1 ELSE f.band END, CASE WHEN -s.y1 - f.anchor > 4.0 THEN -s.y1 ELSE f.anchor END
             FROM fold f JOIN srt s ON s.doc_id = f.doc_id AND s.page_no = f.page_no AND s.r = f.r + 1)"""

#: Stored blocks, cuts, chapters and outline.
_STORED = """
    b AS (SELECT DISTINCT doc_id, block_no, kind, level, page_no, coalesce(text, '') AS text, first_line_indent_em, space_before_em FROM blocks),
    pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS nth FROM b),
    lvl AS (SELECT doc_id, k, count(*) FILTER (kind = 'h' || k) AS n, min(nth) FILTER (kind = 'h' || k) AS lead FROM pos CROSS JOIN (VALUES (1), (2), (3)) v(k) GROUP BY doc_id, k),
    ok AS (SELECT doc_id, k, n + CASE WHEN lead > 1 THEN 1 ELSE 0 END AS chapters, lead FROM lvl WHERE n > 0),
    chosen AS (SELECT doc_id, k AS cut, chapters, lead FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN chapters >= 2 THEN 0 ELSE 1 END, CASE WHEN chapters >= 2 THEN k ELSE -k END) = 1),
    cut AS (SELECT doc_id, coalesce(cut, 0)::INTEGER AS cut, coalesce(chapters, 1)::INTEGER AS chapters, coalesce(lead, 0)::INTEGER AS lead FROM (SELECT DISTINCT doc_id FROM b) LEFT JOIN chosen USING (doc_id))"""
_CHAPTERS = f"""
    run AS (SELECT b.*, cut.cut, lead, sum((kind = 'h' || cut)::INTEGER) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS n FROM b JOIN cut USING (doc_id)),
    ch AS (SELECT *, (n + CASE WHEN lead > 1 OR cut = 0 THEN 1 ELSE 0 END)::INTEGER AS chapter FROM run WHERE cut = 0 OR n > 0 OR lead > 1),
    ct AS (SELECT doc_id, chapter, coalesce(max({_clean('text')}) FILTER (kind = 'h' || cut AND cut > 0), '') AS chapter_title FROM ch GROUP BY ALL),
    ol AS (SELECT doc_id, (row_number() OVER w - 1)::INTEGER AS entry_no, substr(kind, 2, 1)::INTEGER AS level, {_clean('text')} AS title, chapter, 'h' || row_number() OVER w AS anchor, block_no
           FROM ch WHERE kind IN ('h1', 'h2', 'h3') AND {_clean('text')} <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY block_no))"""
_BOOKS = "latest AS (SELECT doc_id, path, title, author, total_pages FROM books QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC, path DESC, title DESC NULLS LAST, author DESC NULLS LAST) = 1)"


def _esc(t: str) -> str:
    return f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _title_author(title: str, author: str, path: str) -> tuple[str, str]:
    stem = f"regexp_replace(regexp_replace({path}, '^.*/', ''), '^(.+)\\.[^.]+$', '\\1')"
    stem = _strip(f"regexp_replace({stem}, {_s(WS + '*[(\\[]?(?:' + '|'.join(_EDITION_WORDS) + ')[^)\\]]*[)\\]]?$')}, '')")
    parts = f"list_filter(list_transform(regexp_split_to_array({stem}, {_s(WS + '*[،,]' + WS + '*')}), lambda x: {_strip('x')}), lambda x: x <> '')"
    ti, au = _strip(f"coalesce({title}, '')"), _strip(f"coalesce({author}, '')")
    named = f"(len({parts}) >= 2 AND {au} = '')"
    return (
        f"CASE WHEN {ti} <> '' THEN {ti} WHEN {named} THEN array_to_string({parts}[2:], '، ') ELSE {stem} END",
        f"CASE WHEN {ti} = '' AND {named} THEN {parts}[1] ELSE {au} END",
    )


_FONTS = f"""
    adm AS (SELECT *, regexp_replace(path, '^.*/', '') AS name, regexp_replace(regexp_replace(path, '^.*/', ''), '^(.+)\\.[^.]+$', '\\1') AS stem FROM (SELECT DISTINCT * FROM fonts) WHERE coverage >= 40 AND coalesce(family, '') <> '' AND family NOT LIKE '.%'),
    fl AS (SELECT *, regexp_matches(stem, {_s(_BOLD_FILE)}) AS b, regexp_matches(stem, {_s(_ITALIC_FILE)}) AS i, regexp_matches(stem, {_s(_NOT_REGULAR)}) AS odd,
             len(list_filter([{', '.join(map(_s, _OPEN_LICENCES))}], lambda m: contains(lower(coalesce(license_text, '')), m))) > 0 AS open, row_number() OVER (PARTITION BY family ORDER BY length(name), name, path) AS r FROM adm),
    pl AS (SELECT family, r, CASE WHEN NOT b AND NOT i AND NOT odd THEN path END AS regular, CASE WHEN b AND NOT i THEN path END AS bold, CASE WHEN i AND NOT b THEN path END AS italic, CASE WHEN b AND i THEN path END AS bold_italic FROM fl WHERE r = 1 UNION ALL
           SELECT f.family, f.r, CASE WHEN face = 'regular' THEN path ELSE regular END, CASE WHEN face = 'bold' THEN path ELSE bold END, CASE WHEN face = 'italic' THEN path ELSE italic END, CASE WHEN face = 'bold_italic' THEN path ELSE bold_italic END
           FROM (SELECT fl.family, fl.r, fl.path, pl.regular, pl.bold, pl.italic, pl.bold_italic, CASE WHEN b AND i AND pl.bold_italic IS NULL THEN 'bold_italic' WHEN b AND pl.bold IS NULL THEN 'bold' WHEN i AND pl.italic IS NULL THEN 'italic' WHEN pl.regular IS NULL AND NOT odd THEN 'regular' END AS face
                 FROM pl JOIN fl ON fl.family = pl.family AND fl.r = pl.r + 1) f),
    faces AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY family ORDER BY r DESC) = 1),
    wide AS (SELECT family, coverage, probe FROM fl QUALIFY row_number() OVER (PARTITION BY family ORDER BY coverage DESC, r) = 1),
    fam AS (SELECT faces.family, coalesce(regular, (SELECT path FROM fl WHERE fl.family = faces.family AND fl.r = 1)) AS regular, bold, italic, bold_italic, coverage, probe, (SELECT bool_and(open) FROM fl WHERE fl.family = faces.family) AS redistributable FROM faces JOIN wide USING (family)),
    families AS (SELECT *, row_number() OVER (ORDER BY coalesce((SELECT min(i) FROM generate_series(1, {len(_PREFERRED)}) g(i) WHERE contains(lower(trim(family)), [{', '.join(map(_s, _PREFERRED))}][i])), {len(_PREFERRED) + 1}), probe DESC, redistributable DESC, coverage DESC, lower(family), family)::INTEGER AS rank FROM fam)"""

_MARKUP = f"""
    mk AS (SELECT ch.doc_id, ch.chapter, ct.chapter_title, ch.block_no, {_esc('ch.text')} AS inner_text, ch.text, ch.kind, ol.anchor, ch.first_line_indent_em AS fi, ch.space_before_em AS sb, ch.level
           FROM ch JOIN ct USING (doc_id, chapter) LEFT JOIN ol ON ol.doc_id = ch.doc_id AND ol.block_no = ch.block_no),
    md AS (SELECT doc_id, chapter, chapter_title, block_no, CASE WHEN {_clean('text')} = '' THEN ''
             WHEN kind IN ('h1', 'h2', 'h3') THEN '<h' || greatest(1, least(6, CASE WHEN coalesce(level, 0) > 0 THEN level ELSE substr(kind, 2, 1)::INTEGER END)) || CASE WHEN anchor IS NULL THEN '' ELSE ' id="' || anchor || '"' END || '>' || inner_text || '</h' || greatest(1, least(6, CASE WHEN coalesce(level, 0) > 0 THEN level ELSE substr(kind, 2, 1)::INTEGER END)) || '>'
             WHEN kind = 'note' THEN '<aside class="note">' || inner_text || '</aside>'
             WHEN kind = 'p' THEN '<p style="text-indent: ' || printf('%.2f', coalesce(fi, 1.6)) || 'em' || CASE WHEN sb IS NULL THEN '' ELSE '; margin-top: ' || printf('%.2f', sb) || 'em' END || '">' || inner_text || '</p>' ELSE '<p>' || inner_text || '</p>' END AS markup FROM mk)"""
_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="fa-IR" lang="fa-IR" dir="rtl">\n'
_T, _A = _title_author("title", "author", "path")
_FT_, _FA = _title_author("NULL", "NULL", "concat_ws('، ', author, title, 'چاپ ۲.pdf')")
_NEST = """
    pr AS (SELECT o.doc_id, o.entry_no, max(p.entry_no) AS parent FROM {t} o LEFT JOIN {t} p ON p.doc_id = o.doc_id AND p.entry_no < o.entry_no AND p.level < o.level GROUP BY ALL),
    dp AS (SELECT doc_id, entry_no, 0 AS depth FROM pr WHERE parent IS NULL UNION ALL SELECT pr.doc_id, pr.entry_no, dp.depth + 1 FROM dp JOIN pr ON pr.doc_id = dp.doc_id AND pr.parent = dp.entry_no)"""

ORACLES = {
    "n01_strip_bidi": _spans(out=_translate("text", _BIDI_CONTROLS + _ZWJ, "")),
    "n02_presentation_forms": _spans(out=_forms("text")),
    "n03_fold_letters": _spans(out=_translate("text", _FOLD_FROM + _ARABIC_DIGITS, _FOLD_TO + _PERSIAN_DIGITS)),
    "n04_ascii_digits": _spans(out=_translate("text", _ASCII_DIGITS, _PERSIAN_DIGITS)),
    "n05_drop_tatweel": _spans(out=f"replace(text, {_s(_TATWEEL)}, '')"),
    "n06_looks_mirrored": f"SELECT DISTINCT block_id, {_mirrored('text')} AS mirrored, {_mirrored(_backwards('text'))} AS backwards FROM blocks WHERE text IS NOT NULL",
    "n07_unmirror": _spans(out=_unmirror("text")),
    "n08_brackets": _spans(out=_brackets("translate(text, '()[]', ')(][')"), repaired=_brackets("translate(text, '()[]', ')(][')", True)),
    "n09_detached_marks": _spans(out=_marks("text")),
    "n10_zwnj": _spans(out=_zwnj("text")),
    "n11_prefixes": _spans(out=_prefixes("text")),
    "n13_collapse_lines": _spans(out=_lines("text")),
    "n14_collapse_fragment": _spans(out=_fragment("text")),
    "n15_typography": _spans(out=_translate("text", _TYPOGRAPHY_FROM, _TYPOGRAPHY_TO)),
    "n16_normalize": f"WITH {_NORMAL} SELECT * FROM normal",
    "n17_has_arabic_script": _spans(out="regexp_matches(text, '[\\x{600}-\\x{6ff}]')"),
    "n18_repairs": f"WITH {_NORMAL} SELECT doc_id, sum(mirrored::INTEGER)::BIGINT AS mirrored, sum(brackets_repaired)::BIGINT AS brackets_repaired, sum(marks_removed)::BIGINT AS marks_removed, sum(zwnj_removed)::BIGINT AS zwnj_removed, sum(zwnj_added)::BIGINT AS zwnj_added FROM normal GROUP BY doc_id",
    "n19_escape": _spans(out=_esc("text")),
    "n20_clean": _spans(out=_clean("text")),
    "n21_title_author": f"SELECT DISTINCT doc_id, path, {_T} AS title, {_A} AS author, {_FT_} AS file_title, {_FA} AS file_author FROM books",
    "n22_versions": "SELECT p_partkey, 'v' || (p_size % 3) || '.' || p_size || '.' || (p_partkey % 7) AS version, (p_size % 3) > 1 OR ((p_size % 3) = 1 AND (p_size > 25 OR (p_size = 25 AND (p_partkey % 7) > 0))) AS newer FROM part",
    "x01_private_use": _spans(out="regexp_matches(text, '[zq]')", points="CASE WHEN contains(text, 'z') AND contains(text, 'q') THEN '57345,1048577' WHEN contains(text, 'z') THEN '57345' WHEN contains(text, 'q') THEN '1048577' ELSE '' END"),
    "x03_guard": """WITH m AS (SELECT doc_id, min(page_no) AS page_no FROM spans WHERE regexp_matches(text, '[zq]') GROUP BY doc_id)
        SELECT m.doc_id, m.page_no, concat_ws(' ', CASE WHEN bool_or(contains(text, 'z')) THEN 'U+E001' END, CASE WHEN bool_or(contains(text, 'q')) THEN 'U+100001' END) AS sample FROM m JOIN spans s ON s.doc_id = m.doc_id AND s.page_no = m.page_no GROUP BY ALL""",
    "x04_fill_fonts": f"SELECT {_K}, last_value(font IGNORE NULLS) OVER (PARTITION BY doc_id, page_no ORDER BY line_no, span_no ROWS UNBOUNDED PRECEDING) AS font FROM (SELECT DISTINCT {_K}, font FROM spans)",
    "x05_without_contained": _SEGMENTS + """,
        al AS (SELECT doc_id, page_no, seg_no, loc, len FROM sg UNION ALL SELECT doc_id, page_no, seg_no + 100000, loc + 1, len - 2 FROM sg WHERE seg_no % 2 = 0 AND len > 2)
        SELECT * FROM al a WHERE NOT EXISTS (SELECT 1 FROM al b WHERE b.doc_id = a.doc_id AND b.page_no = a.page_no AND b.seg_no <> a.seg_no AND b.loc <= a.loc AND a.loc + a.len <= b.loc + b.len AND (b.len > a.len OR b.seg_no < a.seg_no))""",
    "x06_bands": _BANDS + " SELECT doc_id, page_no, seg_no, band FROM fold",
    "x07_band_boxes": _BANDS + """ SELECT doc_id, page_no, band, min(x0) AS x0, max(height) - max(y1) AS top, max(x1) AS x1, max(height) - min(y0) AS bottom FROM fold JOIN sg USING (doc_id, page_no, seg_no) JOIN pg USING (doc_id, page_no) GROUP BY doc_id, page_no, band""",
    "x08_interval_gaps": f"SELECT DISTINCT {_K}, greatest(0.0, greatest(200.0, x0) - least(300.0, x1)) AS gap FROM spans",
    "x10_newline_lines": f"SELECT doc_id, (i - 1)::INTEGER AS line_no, string_split(text, chr(10))[i] AS text FROM documents, generate_series(1, len(string_split(text, chr(10)))) g(i) WHERE text IS NOT NULL AND NOT regexp_full_match(string_split(text, chr(10))[i], {_s(WS + '*')})",
    "x12_baseline_ids": f"WITH {_LINES}, f AS (SELECT doc_id, page_no, round(top, 1) AS y, min(line_no) AS first FROM ln GROUP BY ALL), g AS (SELECT *, (dense_rank() OVER (PARTITION BY doc_id ORDER BY page_no, first) - 1)::INTEGER AS block_id FROM f) SELECT ln.doc_id, ln.page_no, ln.line_no, block_id FROM ln JOIN g ON g.doc_id = ln.doc_id AND g.page_no = ln.page_no AND g.y = round(ln.top, 1)",
    "x13_lines": f"""WITH {_LINES}, fo AS (SELECT doc_id, page_no, line_no, string_agg(font, '|' ORDER BY f) AS fonts FROM (SELECT doc_id, page_no, line_no, coalesce(font, '-') AS font, min(span_no) AS f FROM sp GROUP BY ALL) GROUP BY ALL)
        SELECT doc_id, page_no, line_no, text, size, bold, italic, chars, x0, top, x1, bottom, (x0 + x1) / 2 AS x_center, fonts FROM ln JOIN fo USING (doc_id, page_no, line_no)""",
    "x16_centered": f"WITH {_LINES} SELECT doc_id, page_no, line_no, coalesce(width <> 0 AND x1 <> 0 AND abs((x0 + x1) / 2 - width / 2) < width * 0.06, false) AS centered FROM ln LEFT JOIN pg USING (doc_id, page_no)",
    "x17_pages": f"WITH {_LINES} SELECT doc_id, page_no, coalesce(sum(chars), 0)::BIGINT AS chars, coalesce(sum(chars), 0) < 40 AS scanned FROM pg LEFT JOIN ln USING (doc_id, page_no) GROUP BY doc_id, page_no",
    "x17_documents": f"WITH {_LINES}, pf AS (SELECT doc_id, page_no, coalesce(sum(chars), 0) < 40 AS scanned FROM pg LEFT JOIN ln USING (doc_id, page_no) GROUP BY ALL) SELECT doc_id, count(*) AS pages, count(*) FILTER (scanned) AS scanned_pages, count(*) FILTER (scanned) / count(*) < 0.5 AS born_digital FROM pf GROUP BY doc_id",
    "x18_size_histogram": f"WITH {_LINES}, {_BODY} SELECT doc_id, size, chars FROM hist",
    "x19_body_size": f"WITH {_LINES}, {_BODY} SELECT * FROM bd",
    "x20_top_sizes": f"WITH {_LINES}, {_BODY} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first))::INTEGER AS rank, size, chars FROM hist QUALIFY rank <= 5",
    "a01_size_tiers": f"WITH RECURSIVE {_LINES}, {_BODY}, {_TIERS} SELECT doc_id, array_to_string(tiers, ',') AS tiers FROM tr",
    "a03_running_heads": f"WITH {_LINES}, {_HEADS} SELECT * FROM rh",
    "a04_page_leading": f"WITH {_LINES}, {_BODY}, {_LEADING} SELECT * FROM mg",
    "a05_right_edge": f"WITH {_LINES}, {_BODY}, {_LEADING} SELECT * FROM re",
    "line_classes": _ALL + " SELECT doc_id, page_no, line_no, class, level FROM lv",
    **{name: f"""{_ALL}, {_block_rules(keep)},
        kb AS (SELECT doc_id, block_no, any_value(kind) AS kind FROM num {'' if keep else "WHERE class <> 'note'"} GROUP BY ALL),
        kc AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (kind = 'h1') AS h1, count(*) FILTER (kind = 'h2') AS h2, count(*) FILTER (kind = 'h3') AS h3, count(*) FILTER (kind = 'p') AS p, count(*) FILTER (kind = 'note') AS note FROM kb GROUP BY ALL),
        dr AS (SELECT doc_id, count(*) FILTER (class = 'running') AS dropped_running, count(*) FILTER (class = 'folio') AS dropped_folio, {'0::BIGINT' if keep else "count(*) FILTER (class = 'note')"} AS dropped_notes FROM lv GROUP BY doc_id)
        SELECT dr.*, coalesce(blocks, 0) AS blocks, coalesce(h1, 0) AS h1, coalesce(h2, 0) AS h2, coalesce(h3, 0) AS h3, coalesce(p, 0) AS p, coalesce(note, 0) AS note FROM dr LEFT JOIN kc USING (doc_id)""" for name, keep in (("a07_run_stats", True), ("a07_without_notes", False))},
    "w05_block_numbers": f"{_ALL}, {_block_rules(True)} SELECT doc_id, page_no, line_no, block_no, kind, indent, space FROM num",
    "w05_without_notes": f"{_ALL}, {_block_rules(False)} SELECT doc_id, page_no, line_no, block_no, kind FROM num WHERE class <> 'note'",
    "blocks": f"""{_ALL}, {_block_rules(True)},
        frs AS (SELECT doc_id, block_no, kind, level, page_no, indent, space FROM num QUALIFY row_number() OVER (PARTITION BY doc_id, block_no ORDER BY page_no, line_no) = 1),
        txt AS (SELECT doc_id, block_no, {_strip("regexp_replace(string_agg(text, ' ' ORDER BY page_no, line_no), " + _s(WS + '+') + ", ' ', 'g')")} AS text FROM num GROUP BY ALL)
        SELECT doc_id, block_no, kind, level, page_no, text, CASE WHEN kind = 'p' THEN indent END AS first_line_indent_em, CASE WHEN kind = 'p' THEN space END AS space_before_em FROM frs JOIN txt USING (doc_id, block_no)""",
    "a06_block_counts": "SELECT doc_id, kind, count(*) AS n FROM (SELECT DISTINCT doc_id, block_no, kind, level, page_no, text, first_line_indent_em, space_before_em FROM blocks) GROUP BY ALL",
    "a08_report": f"""WITH {_LINES}, {_BOOKS}, {_NORMAL.replace("text FROM spans WHERE", "translate(text, '()[]', ')(][') AS text FROM spans WHERE")}, br AS (SELECT doc_id, sum(brackets_repaired)::BIGINT AS brackets FROM normal GROUP BY doc_id), pf AS (SELECT doc_id, page_no, coalesce(sum(chars), 0) < 40 AS scanned FROM pg LEFT JOIN ln USING (doc_id, page_no) GROUP BY ALL),
        df AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (scanned) AS scanned_pages FROM pf GROUP BY ALL),
        kd AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (kind IN ('h1', 'h2', 'h3')) AS headings, 'h1=' || count(*) FILTER (kind = 'h1') || ',h2=' || count(*) FILTER (kind = 'h2') || ',h3=' || count(*) FILTER (kind = 'h3') || ',note=' || count(*) FILTER (kind = 'note') || ',p=' || count(*) FILTER (kind = 'p') AS counts
               FROM (SELECT DISTINCT doc_id, block_no, kind, level, page_no, text, first_line_indent_em, space_before_em FROM blocks) GROUP BY ALL)
        SELECT doc_id, {_T} AS title, {_A} AS author, coalesce(pages, 0) AS pages_read, coalesce(total_pages, 0) AS pages_total, coalesce(scanned_pages, 0) AS scanned_pages, coalesce(blocks, 0) AS blocks, coalesce(headings, 0) AS headings, coalesce(counts, 'h1=0,h2=0,h3=0,note=0,p=0') AS counts,
          concat_ws('; ', CASE WHEN scanned_pages > 0 THEN scanned_pages || ' pages have no text layer' END, 'the licence of Nastaran is unknown', CASE WHEN brackets > 0 THEN brackets || ' brackets were repaired' END) AS warnings, regexp_extract(path, '^(.*/)?[^/]*$', 1) || 'converted/' || regexp_replace(regexp_replace(path, '^.*/', ''), '^(.+)\\.[^.]+$', '\\1') || '.mobi' AS primary_path
        FROM latest LEFT JOIN df USING (doc_id) LEFT JOIN kd USING (doc_id) LEFT JOIN br USING (doc_id)""",
    "a08_routes": "SELECT DISTINCT path, regexp_extract(path, '^(.*/)?[^/]*$', 1) || 'converted/' || regexp_replace(regexp_replace(path, '^.*/', ''), '^(.+)\\.[^.]+$', '\\1') || '.epub' AS epub_path, regexp_extract(path, '^(.*/)?[^/]*$', 1) || 'converted/' || regexp_replace(regexp_replace(path, '^.*/', ''), '^(.+)\\.[^.]+$', '\\1') || '.mobi' AS mobi_path FROM books",
    "a09_font_families": f"WITH RECURSIVE {_FONTS} SELECT * FROM families",
    "pred_redistributable": f"SELECT DISTINCT path, coverage % 3 = 0 OR len(list_filter([{', '.join(map(_s, _OPEN_LICENCES))}], lambda m: contains(lower(coalesce(license_text, '')), m))) > 0 AS open FROM fonts",
    "font_pick": f"""WITH RECURSIVE {_FONTS}, w AS (SELECT DISTINCT regexp_replace(coalesce(font, ''), '^[A-Z]{{6}}[+]|-.*$', '', 'g') AS wanted FROM spans)
        SELECT wanted, family FROM w CROSS JOIN families QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY CASE WHEN wanted = '' THEN 2 WHEN lower(trim(family)) = lower(trim(wanted)) THEN 0 WHEN contains(lower(trim(family)), lower(trim(wanted))) THEN 1 ELSE 2 END, rank) = 1""",
    "s12_face_files": f"WITH RECURSIVE {_FONTS} SELECT family, 'regular' AS face, regular AS path FROM families UNION ALL SELECT family, 'bold', bold FROM families WHERE bold IS NOT NULL UNION ALL SELECT family, 'italic', italic FROM families WHERE italic IS NOT NULL UNION ALL SELECT family, 'bold_italic', bold_italic FROM families WHERE bold_italic IS NOT NULL",
    "s06_probe": "WITH g AS (SELECT doc_id, sum(length(text))::BIGINT AS chars, sum(length(regexp_replace(text, '[^؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]', '', 'g')))::BIGINT AS arabic FROM (SELECT DISTINCT doc_id, page_no, line_no, text FROM page_lines) WHERE page_no < 4 GROUP BY doc_id) SELECT doc_id, chars, arabic, arabic / chars AS ratio, chars > 200 AS text_layer FROM g WHERE chars > 0",
    "c01_cut_levels": f"WITH {_STORED} SELECT * FROM cut",
    "c02_chapters": f"WITH {_STORED}, {_CHAPTERS} SELECT doc_id, block_no, cut, chapter, chapter_title FROM ch JOIN ct USING (doc_id, chapter)",
    "c03_anchors": f"WITH {_STORED}, {_CHAPTERS} SELECT * FROM ol",
    "c04_nested": f"WITH RECURSIVE {_STORED}, {_CHAPTERS}, {_NEST.format(t='ol')} SELECT pr.doc_id, pr.entry_no, coalesce(parent, -1)::INTEGER AS parent, depth FROM pr JOIN dp ON dp.doc_id = pr.doc_id AND dp.entry_no = pr.entry_no",
    "c04_stored_outline": "SELECT DISTINCT doc_id, entry_no, coalesce(parent_no, -1) AS parent, coalesce(parent_no, -1) AS parent_no FROM outline",
    "c05_play_order": f"WITH {_STORED}, {_CHAPTERS} SELECT doc_id, entry_no, (entry_no + 1)::INTEGER AS play_order, max(level) OVER (PARTITION BY doc_id) AS depth FROM ol",
    "c06_hrefs": f"WITH {_STORED}, {_CHAPTERS} SELECT doc_id, entry_no, printf('text/ch%03d.xhtml', chapter) || '#' || anchor AS href FROM ol",
    "r02_block_markup": f"WITH {_STORED}, {_CHAPTERS}, {_MARKUP} SELECT doc_id, chapter, block_no, markup FROM md",
    "r03_chapter_documents": f"""WITH {_STORED}, {_CHAPTERS}, {_MARKUP} SELECT doc_id, chapter, chapter_title, {_s(_HEAD + '<head><meta charset="utf-8"/><title>')} || {_esc("CASE WHEN chapter_title <> '' THEN chapter_title ELSE '—' END")} || {_s('</title><link rel="stylesheet" type="text/css" href="../style/book.css"/></head>' + chr(10) + '<body dir="rtl">' + chr(10) + '<section epub:type="chapter">' + chr(10))}
        || string_agg(markup, chr(10) ORDER BY block_no) || {_s(chr(10) + '</section>' + chr(10) + '</body>' + chr(10) + '</html>' + chr(10))} AS document FROM md WHERE markup <> '' GROUP BY doc_id, chapter, chapter_title""",
    "r07_title_pages": f"""WITH {_BOOKS}, t AS (SELECT doc_id, {_T} AS title, {_A} AS author FROM latest) SELECT doc_id, CASE WHEN title = '' AND author = '' THEN '' ELSE '<section class="titlepage" epub:type="titlepage">' || CASE WHEN title <> '' THEN '<p class="book-title">' || {_esc('title')} || '</p>' ELSE '' END
        || CASE WHEN author <> '' THEN '<p class="book-author">' || {_esc('author')} || '</p>' ELSE '' END || '</section>' END AS page FROM t""",
    "pred_numbering": _spans(out="regexp_matches(text, '^[۰-۹0-9. ]+$')"),
    "pred_folio": _spans(out=f"regexp_matches(text, {_s(_FOLIO)})"),
    "pred_heading_form": _spans(out=_heading("text")),
    "pred_new_files": "SELECT DISTINCT path FROM (SELECT upper(path) AS path FROM books UNION ALL SELECT path FROM books) WHERE lower(path) LIKE '%.pdf' AND path NOT IN (SELECT path FROM books WHERE total_pages > 2)",
}
ORACLES["pred_arabic_corpus"] = f"SELECT * FROM ({ORACLES['s06_probe']}) WHERE ratio > 0.25 AND arabic > 400 ORDER BY ratio DESC, doc_id LIMIT 30"

_STYLED = f"""
    wrd AS (SELECT num.doc_id, num.block_no, num.page_no, num.line_no, span_no, sp.text, coalesce(regexp_matches(font, '(?i)bold|black|heavy|semibold|demi'), false) AS bold, coalesce(regexp_matches(font, '(?i)italic|oblique'), false) AS italic
            FROM num JOIN sp USING (doc_id, page_no, line_no) WHERE sp.text <> ''),
    sep AS (SELECT doc_id, block_no, page_no, line_no, -1 AS span_no, ' ' AS text, false AS bold, false AS italic FROM (SELECT DISTINCT doc_id, block_no, page_no, line_no FROM wrd) QUALIFY row_number() OVER (PARTITION BY doc_id, block_no ORDER BY page_no, line_no) > 1),
    allr AS (SELECT * FROM wrd UNION ALL SELECT * FROM sep),
    isl AS (SELECT *, CASE WHEN lag(bold) OVER w = bold AND lag(italic) OVER w = italic THEN 0 ELSE 1 END AS new FROM allr WINDOW w AS (PARTITION BY doc_id, block_no ORDER BY page_no, line_no, span_no)),
    rno AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id, block_no ORDER BY page_no, line_no, span_no ROWS UNBOUNDED PRECEDING) - 1)::INTEGER AS run_no FROM isl),
    runs AS (SELECT doc_id, block_no, run_no, string_agg(text, '' ORDER BY page_no, line_no, span_no) AS text, bool_or(bold) AS bold, bool_or(italic) AS italic FROM rno GROUP BY ALL)"""
_IN = "CASE WHEN bold THEN '<strong>' || " + _esc("text") + " || '</strong>' ELSE " + _esc("text") + " END"
ORACLES |= {
    "w06_style_runs": f"{_ALL}, {_block_rules(True)}, {_STYLED} SELECT * FROM runs",
    "r01_inline": f"""{_ALL}, {_block_rules(True)}, {_STYLED}, inl AS (SELECT doc_id, block_no, string_agg(CASE WHEN italic THEN '<em>' || {_IN} || '</em>' ELSE {_IN} END, '' ORDER BY run_no) AS markup FROM runs GROUP BY ALL)
        SELECT doc_id, block_no, coalesce(markup, '') AS markup FROM (SELECT DISTINCT doc_id, block_no FROM num) LEFT JOIN inl USING (doc_id, block_no)""",
    "r04_contents": f"""WITH RECURSIVE {_STORED}, {_CHAPTERS}, {_NEST.format(t='ol')},
        nd AS (SELECT ol.doc_id, ol.entry_no, title, chapter, anchor, depth, coalesce(lead(depth) OVER (PARTITION BY ol.doc_id ORDER BY ol.entry_no), 0) AS nxt FROM ol JOIN dp ON dp.doc_id = ol.doc_id AND dp.entry_no = ol.entry_no)
        SELECT doc_id, '<ol>' || string_agg('<li><a href="' || printf('text/ch%03d.xhtml', chapter) || '#' || anchor || '">' || {_esc('title')} || '</a>' || CASE WHEN nxt > depth THEN '<ol>' ELSE '</li>' || repeat('</ol></li>', depth - nxt) END, '' ORDER BY entry_no) || '</ol>' AS toc FROM nd GROUP BY doc_id""",
}
_LINE_BANDS = f"""WITH RECURSIVE {_LINES},
    lg AS (SELECT doc_id, page_no, line_no, sum(length(text)) AS len, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom FROM sp WHERE text <> '' GROUP BY ALL),
    sg AS (SELECT doc_id, page_no, line_no, (row_number() OVER w - 1)::INTEGER AS seg_no, coalesce(sum(len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS loc, x0, x1, height - bottom AS y0, height - top AS y1
           FROM lg JOIN pg USING (doc_id, page_no) WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no))""" + _BANDS[len(_SEGMENTS):]
#: Spans of equal size and font that follow each other in a line, as one.
_ISLANDS = """
    ir AS (SELECT *, CASE WHEN lag(span_no) OVER w IS NOT NULL AND lag(size) OVER w IS NOT DISTINCT FROM size AND coalesce(lag(font) OVER w, '') = coalesce(font, '') THEN 0 ELSE 1 END AS fresh FROM sp WHERE text <> '' WINDOW w AS (PARTITION BY doc_id, page_no, line_no ORDER BY span_no)),
    ii AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY span_no ROWS UNBOUNDED PRECEDING) AS isl FROM ir),
    im AS (SELECT doc_id, page_no, line_no, isl, string_agg(text, '' ORDER BY span_no) AS text, any_value(size) AS size, coalesce(any_value(font), '') AS font FROM ii GROUP BY doc_id, page_no, line_no, isl)"""
ORACLES |= {
    "x09_band_spans": _LINE_BANDS + f""", {_ISLANDS},
        ed AS (SELECT doc_id, page_no, line_no, arg_min(text, isl)[1] AS head, arg_max(text, isl)[-1] AS tail, arg_max(size, isl) AS last FROM im GROUP BY ALL),
        tx AS (SELECT fold.doc_id, fold.page_no, band, loc, seg_no, line_no, x0, x1, head, tail, last FROM fold JOIN sg USING (doc_id, page_no, seg_no) JOIN ed USING (doc_id, page_no, line_no)),
        pv AS (SELECT *, lag(tail) OVER w AS pt, lag(last) OVER w AS ps, lag(x0) OVER w AS p0, lag(x1) OVER w AS p1 FROM tx WINDOW w AS (PARTITION BY doc_id, page_no, band ORDER BY loc, seg_no)),
        gp AS (SELECT *, coalesce(greatest(0.0, greatest(p0, x0) - least(p1, x1)) > greatest(2.5, ps * 0.2) AND NOT regexp_full_match(pt, WSP) AND NOT regexp_full_match(head, WSP), false) AS space FROM pv),
        al AS (SELECT gp.doc_id, gp.page_no, band, loc, seg_no, isl AS k, text, size, font FROM gp JOIN im USING (doc_id, page_no, line_no) UNION ALL SELECT doc_id, page_no, band, loc, seg_no, 0, ' ', ps, '' FROM gp WHERE space)
        SELECT doc_id, page_no, band, (row_number() OVER (PARTITION BY doc_id, page_no, band ORDER BY loc, seg_no, k) - 1)::INTEGER AS span_no, text, size, font FROM al""".replace("WSP", _s("[" + WS[1:-1] + "«»()" + chr(92) + "[" + chr(92) + "]{}.,،؛؟!:;…ً-ٰٕ]")),
    "x10_newline_spans": f"""WITH {_LINES}, {_ISLANDS},
        wh AS (SELECT doc_id, page_no, line_no FROM sp GROUP BY ALL HAVING NOT regexp_full_match(string_agg(text, '' ORDER BY span_no), {_s(WS + '*')})),
        nr AS (SELECT doc_id, page_no, line_no, (dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1)::INTEGER AS n FROM (SELECT DISTINCT doc_id, page_no, line_no FROM sp))
        SELECT im.doc_id, im.page_no, n AS line_no, (isl - 1)::INTEGER AS span_no, text, coalesce(size, 0.0) AS size, font FROM im JOIN wh USING (doc_id, page_no, line_no) JOIN nr USING (doc_id, page_no, line_no)""",
}
_RAW_SPANS = "SELECT DISTINCT doc_id, page_no, line_no, span_no, coalesce(text, '') AS text, size, font, x0, top, x1, bottom FROM spans"
_REPAIRED = f"SELECT DISTINCT s.doc_id, s.page_no, s.line_no, s.span_no, coalesce(n.text, '') AS text, size, font, x0, top, x1, bottom FROM spans s LEFT JOIN normal n USING ({_K})"
ORACLES["blocks_normalized"] = ORACLES["blocks"].replace("WITH RECURSIVE ", f"WITH RECURSIVE {_NORMAL}, ", 1).replace(_RAW_SPANS, _REPAIRED, 1)
_TITLE_PAGE = f"""CASE WHEN title = '' AND author = '' THEN '' ELSE '<section class="titlepage" epub:type="titlepage">' || CASE WHEN title <> '' THEN '<p class="book-title">' || {_esc('title')} || '</p>' ELSE '' END
        || CASE WHEN author <> '' THEN '<p class="book-author">' || {_esc('author')} || '</p>' ELSE '' END || '</section>' END"""
_SHEET = """body { font-size: 1em; line-height: 1.85; text-align: justify; }
p { margin: 0; text-indent: 1.6em; }
h1 + p, h2 + p, h3 + p { text-indent: 0; }
h1, h2, h3 { text-align: center; text-indent: 0; page-break-after: avoid; line-height: 1.4; }
h1 { font-size: 1.6em; margin: 2.4em 0 1.2em; }
h2 { font-size: 1.3em; margin: 1.8em 0 0.9em; }
h3 { font-size: 1.1em; margin: 1.4em 0 0.7em; }
aside.note { font-size: 0.85em; margin: 0.8em 1.5em; }
p.caption { text-align: center; font-size: 0.9em; }
div.poem { margin: 1em 2em; text-align: center; }
span.verse { display: inline-block; }
hr { border: 0; border-top: thin solid; width: 30%; margin: 1.5em auto; }
section.titlepage { text-align: center; margin-top: 30%; }
p.book-title { font-size: 1.9em; text-indent: 0; }
p.book-author { font-size: 1.2em; text-indent: 0; }
"""
_STYLE = "</title><style>\n" + _SHEET + "body { max-width: 34em; margin: 0 auto; }\n</style></head>\n"
ORACLES["s11_preview"] = f"""WITH {_STORED}, {_CHAPTERS}, {_MARKUP}, {_BOOKS}, t AS (SELECT doc_id, {_T} AS title, {_A} AS author FROM latest),
        g AS (SELECT doc_id, string_agg(markup, chr(10) ORDER BY block_no) AS body FROM md WHERE markup <> '' GROUP BY doc_id)
        SELECT doc_id, {_s('<!DOCTYPE html>' + chr(10) + '<html lang="fa-IR" dir="rtl">' + chr(10) + '<head><meta charset="utf-8"/><title>')} || {_esc("CASE WHEN coalesce(title, '') <> '' THEN title ELSE 'preview' END")} || {_s(_STYLE + '<body dir="rtl">' + chr(10))}
        || concat_ws(chr(10), nullif({_TITLE_PAGE.replace("title = ''", "coalesce(title, '') = ''").replace("author = ''", "coalesce(author, '') = ''")}, ''), body) || {_s(chr(10) + '</body>' + chr(10) + '</html>' + chr(10))} AS html FROM g LEFT JOIN t USING (doc_id)"""


def _xhtml(title: str, body: str, sheet: str = "../style/book.css") -> str:
    return f"""{_s(_HEAD + '<head><meta charset="utf-8"/><title>')} || {title} || {_s('</title><link rel="stylesheet" type="text/css" href="' + sheet + '"/></head>' + chr(10) + '<body dir="rtl">' + chr(10))} || {body} || {_s(chr(10) + '</body>' + chr(10) + '</html>' + chr(10))}"""


_DECLARED = '<?xml version="1.0" encoding="utf-8"?>' + chr(10)
_NAME = f"coalesce({_esc('title')}, 'کتاب')"
ORACLES["s08_packages"] = f"""WITH RECURSIVE {_STORED}, {_CHAPTERS}, {_MARKUP}, {_BOOKS}, {_NEST.format(t='ol')},
        doc AS (SELECT doc_id, chapter, document FROM ({ORACLES['r03_chapter_documents'].split('FROM md')[0].split(_MARKUP)[1]} FROM md WHERE markup <> '' GROUP BY doc_id, chapter, chapter_title)),
        bk AS (SELECT doc_id, nullif(title, '') AS title, nullif(author, '') AS author, sha1('\\x6b\\xa7\\xb8\\x11\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::BLOB || ('document:' || doc_id)::BLOB) AS h
               FROM (SELECT DISTINCT doc_id FROM doc) LEFT JOIN (SELECT doc_id, {_T} AS title, {_A} AS author FROM latest) USING (doc_id)),
        idn AS (SELECT *, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS ident FROM bk),
        en AS (SELECT ol.doc_id, ol.entry_no, depth, level, title, printf('text/ch%03d.xhtml', chapter) || '#' || anchor AS href FROM ol JOIN dp ON dp.doc_id = ol.doc_id AND dp.entry_no = ol.entry_no
               UNION ALL SELECT doc_id, chapter, 0, 1, 'بخش ' || chapter, printf('text/ch%03d.xhtml', chapter) FROM doc WHERE doc_id NOT IN (SELECT doc_id FROM ol)),
        pt AS (SELECT *, row_number() OVER w AS n, greatest(0, depth - coalesce(lead(depth) OVER w, 0) + 1) AS closed, coalesce(lead(depth) OVER w, 0) AS nxt FROM en WINDOW w AS (PARTITION BY doc_id ORDER BY entry_no)),
        mp AS (SELECT doc_id, max(level) AS depth, string_agg('<navPoint id="n' || n || '" playOrder="' || n || '"><navLabel><text>' || {_esc('title')} || '</text></navLabel><content src="' || href || '"/>' || repeat('</navPoint>', closed), '' ORDER BY n) AS points,
               '<ol>' || string_agg('<li><a href="' || href || '">' || {_esc('title')} || '</a>' || CASE WHEN nxt > depth THEN '<ol>' ELSE '</li>' || repeat('</ol></li>', depth - nxt) END, '' ORDER BY n) || '</ol>' AS toc FROM pt GROUP BY doc_id),
        pa AS (SELECT doc_id, 2 AS g, 0 AS nr, 'style/book.css' AS path, {_s(_SHEET)} AS content, 'text/css' AS media, '' AS prop, false AS spine FROM idn
               UNION ALL SELECT doc_id, 3, 0, 'nav.xhtml', {_xhtml("'فهرست'", "'<nav epub:type=" + '"toc" id="toc"' + "><h1>فهرست</h1>' || toc || '</nav>'", "style/book.css")}, 'application/xhtml+xml', ' properties="nav"', false FROM idn JOIN mp USING (doc_id)
               UNION ALL SELECT doc_id, 4, 0, 'toc.ncx', {_s(_DECLARED + '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1" xml:lang="fa-IR"><head><meta name="dtb:uid" content="')} || ident || '"/><meta name="dtb:depth" content="' || depth || '"/></head><docTitle><text>' || {_NAME} || '</text></docTitle><navMap>' || points || '</navMap></ncx>' || chr(10), 'application/x-dtbncx+xml', '', false FROM idn JOIN mp USING (doc_id)
               UNION ALL SELECT doc_id, 5, 0, 'text/titlepage.xhtml', {_xhtml(_NAME, _TITLE_PAGE.replace("title = ''", "title IS NULL").replace("author = ''", "author IS NULL"))}, 'application/xhtml+xml', '', true FROM idn WHERE title IS NOT NULL OR author IS NOT NULL
               UNION ALL SELECT doc_id, 6, chapter, printf('text/ch%03d.xhtml', chapter), document, 'application/xhtml+xml', '', true FROM doc),
        li AS (SELECT *, 'part' || row_number() OVER (PARTITION BY doc_id ORDER BY g, nr) AS id FROM pa),
        mf AS (SELECT doc_id, string_agg('<item id="' || id || '" href="' || path || '" media-type="' || media || '"' || prop || '/>', '' ORDER BY g, nr) AS items, string_agg(CASE WHEN spine THEN '<itemref idref="' || id || '"/>' ELSE '' END, '' ORDER BY g, nr) AS refs, max(id) FILTER (path = 'toc.ncx') AS ncx FROM li GROUP BY doc_id),
        al AS (SELECT doc_id, g, nr, 'OEBPS/' || path AS name, content FROM li
               UNION ALL SELECT doc_id, 0, 0, 'mimetype', 'application/epub+zip' FROM idn
               UNION ALL SELECT doc_id, 1, 0, 'META-INF/container.xml', {_s(_DECLARED + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>' + chr(10))} FROM idn
               UNION ALL SELECT doc_id, 8, 0, 'OEBPS/content.opf', {_s(_DECLARED + '<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="bookid" xml:lang="fa-IR"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="bookid">')} || ident || '</dc:identifier><dc:title>' || {_NAME}
                   || '</dc:title><dc:language>fa-IR</dc:language>' || coalesce('<dc:creator>' || {_esc('author')} || '</dc:creator>', '') || '<meta property="dcterms:modified">2000-01-01T00:00:00Z</meta></metadata><manifest>' || items || '</manifest><spine toc="' || ncx || '" page-progression-direction="rtl">' || refs || '</spine></package>' || chr(10) FROM idn JOIN mf USING (doc_id))
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g, nr) - 1)::INTEGER AS position, name, CASE WHEN name = 'mimetype' THEN 'stored' ELSE 'deflated' END AS method, content FROM al"""

_PROBE, _CORE_LETTERS, _OWN = "پچژگکیۃ۰۱۲۳۴۵۶۷۸۹", "ابتنم", "پچژکگی۰"
_FACES = f"""
    cps AS (SELECT cp, row_number() OVER () AS n FROM (SELECT cp FROM (SELECT unnest(generate_series(1536, 1791) || generate_series(1872, 1919) || generate_series(64336, 65023) || generate_series(65136, 65279)) AS cp) ORDER BY cp)),
    ft AS (SELECT DISTINCT path, family, license_text, coverage FROM fonts WHERE coverage IS NOT NULL),
    fc AS (SELECT path, 0 AS face_no, CASE WHEN coalesce(family, '') <> '' THEN family ELSE regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '') END AS family,
             count(cp)::INTEGER AS coverage, {', '.join(f"count(*) FILTER (contains('{letters}', chr(cp::INTEGER)))::INTEGER AS {name}" for name, letters in (("probe", _PROBE), ("core", _CORE_LETTERS), ("persian_only", _OWN)))},
             any_value(ft.coverage) % 3 = 0 AS zwnj, count(*) FILTER (cp >= 64336)::INTEGER AS presentation_forms, CASE WHEN any_value(ft.coverage) % 4 <> 0 THEN 'fina,init' ELSE '' END AS features, nullif(any_value(license_text), '') AS license_text, 1000 AS units
           FROM ft LEFT JOIN cps ON n <= ft.coverage GROUP BY path, family, license_text, ft.coverage)"""
ORACLES |= {
    "a10_font_faces": f"WITH {_FACES} SELECT * FROM fc",
    "a11_font_table": f"WITH {_FACES} SELECT path, family, coverage, probe, license_text FROM fc",
    "a12_font_audit": f"""WITH {_FACES} SELECT path, face_no, CASE WHEN presentation_forms > 40 AND features = '' THEN 'LEGACY' WHEN features <> '' AND persian_only >= 5 AND zwnj THEN 'GOOD' WHEN features <> '' AND persian_only >= 5 THEN 'GOOD*'
        WHEN features <> '' THEN 'ARABIC' ELSE 'BROKEN' END AS verdict FROM fc WHERE core > 0 OR persian_only > 0""",
}
