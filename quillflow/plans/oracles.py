"""The queries' results in DuckDB's SQL."""

from __future__ import annotations

from . import settings as s
from ..functions.text import fold_text
from .derive import CONTRACTS_SQL, LAW_PAGES_SQL, LAWS_SQL, LINKS_SQL, NOW, RECORDS_SQL, _list

# Written out here, so that the queries are held against values of their own.  Fixed values.
LAW_ID_ON_PAGE = r"(?i)([0-9]{1,4}/VBHN-[A-Z]{2,6}|[0-9]{1,3}/[0-9]{4}/QH[0-9]{1,2}|[0-9]{1,3}/[0-9]{4}/(?:ND|NĐ)-CP)"
LAW_ID = r"(?i)(?:so\s*)?([0-9]{1,4}/VBHN-[A-Z]{2,6}|[0-9]{1,3}/[0-9]{4}/QH[0-9]{1,2}|[0-9]{1,3}/[0-9]{4}/(?:ND|NĐ)-CP|[0-9]{1,3}/[0-9]{4}/[A-ZĐ]{2,4}(?:-[A-ZĐ]{2,4})?)"
STRUCTURE = ["dieu 1", "khoan 1", "chuong i"]
ARTIFACTS = [
    "trang chu", "quay lai", "in trang", "chia se", "facebook", "twitter", "zalo", "email", "dang nhap", "dang ky", "quang cao", "lien he", "menu", "luoc do",
    "thuoc tinh", "hoi dap", "tin tuc",
]
DEFAULT_DOMAIN = "Thương mại"
#: Of each field, the keywords that the contracts here can have.
DOMAIN_KEYWORDS = {
    "Lao động": ["người lao động", "tiền lương"], "Doanh nghiệp": ["góp vốn", "cổ phần"], "Thương mại": ["hàng hóa", "xuất khẩu"], "Dân sự": ["thừa kế", "bảo lãnh"],
}
WHITE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def fold(x: str) -> str:
    return f"lower(replace(replace(strip_accents(coalesce({x}, '')), 'đ', 'd'), 'Đ', 'D'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, letter in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        out = f"replace({out}, '{entity}', {letter})"
    return strip(out)


def has_any(x: str, phrases: list[str]) -> str:
    return f"(len(list_filter({_list(phrases)}, lambda p: contains({x}, p))) > 0)"


def domain(x: str) -> str:
    return f"replace(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'www.', '')"


def path(x: str) -> str:
    return f"regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def dedup_key(x: str) -> str:
    host = f"lower({domain(x)})"
    own = f"regexp_replace({path(x)}, '/*(;[^/]*)?$', '')"
    gazette = rf"regexp_replace(regexp_replace(regexp_replace({own}, '(?i)\.htm$', '.html'), '(?i)(-\d{{2,7}})/\d+\.html?$', '\1.html'), '(?i)(-\d{{2,7}})/\d+$', '\1')"
    return f"lower(regexp_extract({x}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || {host} || CASE WHEN {host} = 'congbao.chinhphu.vn' THEN {gazette} WHEN lower({own}) IN ('/index.html', '/index.htm', '/default.aspx') THEN '' ELSE {own} END"


def law_id(x: str, pattern: str = LAW_ID) -> str:
    return f"upper(nullif(regexp_extract({fold(x)}, '{pattern}', 1), ''))"


def _date(x: str, pattern: str) -> str:
    day, month, year = (f"regexp_extract({x}, '{pattern}', {k})" for k in (1, 2, 3))
    return f"CASE WHEN TRY_CAST({year} AS INTEGER) BETWEEN 2000 AND 2027 THEN {year} || '-' || lpad({month}, 2, '0') || '-' || lpad({day}, 2, '0') END"


def effective_date(x: str) -> str:
    f = fold(x)
    labelled = r"hieu\s*luc\s*(?:ke\s*tu\s*)?(?:ngay\s+)?[:\-\s]*(\d{1,2})\s*(?:thang)?[/\-\s]+(\d{1,2})\s*(?:nam)?[/\-\s]+(\d{4})"
    spelt = r"ngay\s+(\d{1,2})\s+thang\s+(\d{1,2})\s+nam\s+(\d{4})"
    bare = r"(?i)(?:^|[^A-Z0-9/])(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})(?:$|[^A-Z0-9/\-])"
    whole = r"(?:ngay\s+)?(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"
    tail = rf"CASE WHEN regexp_matches({f}, 'ban\s*hanh\s+') THEN regexp_replace({f}, '^.*?ban\s*hanh\s+', '') END"
    year = rf"regexp_extract({f}, '(?:^|[^A-Z0-9/])(\d{{4}})(?:$|[^A-Z0-9/\-])', 1)"
    steps = [_date(f, labelled), _date(f, spelt), _date(f"({tail})", labelled), _date(f"({tail})", bare), _date(f, whole), f"CASE WHEN TRY_CAST({year} AS INTEGER) BETWEEN 2000 AND 2027 THEN {year} || '-??-??' END"]
    return f"coalesce({', '.join(steps)})"


def date_key(x: str, missing: str = "00000000") -> str:
    digits = f"replace(replace(coalesce(nullif({x}, ''), '{missing}'), '?', '0'), '-', '')"
    return f"CASE WHEN length({digits}) >= 8 THEN {digits} ELSE rpad({digits}, 8, '0') END"


def _rank(x: str) -> str:
    return f"CASE {x} WHEN '{s.SOURCES[0]}' THEN 0 WHEN '{s.SOURCES[1]}' THEN 1 ELSE 2 END"


_BOTH = "coalesce(title, '') || ' ' || coalesce(snippet, '')"
_NAMES = [fold_text(x) for name, aliases, _ in s.LAWS for x in (name, *aliases)]
_ALLOWED = f"({domain('link')} IN ('{s.SOURCES[0]}', '{s.SOURCES[1]}') AND starts_with({path('link')}, '/van-ban/'))"
_CANONICAL = "CASE " + " ".join(f"WHEN {has_any(fold('title'), [fold_text(x) for x in (name, *aliases)])} THEN '{name}'" for name, aliases, _ in s.LAWS) + " END"
_GROUPED = f"g AS (SELECT ord, link AS url, title, {domain('link')} AS source_domain, {law_id(_BOTH)} AS law_id, {effective_date(_BOTH)} AS effective_date, {_CANONICAL} AS law, {_rank(domain('link'))} AS rank FROM links)"


def _matches(rule: dict) -> str:
    out = f"regexp_matches(coalesce(law_id, ''), '(?i){rule['law_id_pattern']}') AND regexp_matches(coalesce(title, ''), '(?i){rule['title_pattern']}')"
    if rule.get("exclude_pattern"):
        out += f" AND NOT regexp_matches(coalesce(law_id, '') || ' ' || coalesce(title, ''), '(?i){rule['exclude_pattern']}')"
    return out


def _chain() -> str:
    parts, winners = [], []
    for i, (law, rules) in enumerate(s.RULES.items()):
        for k, rule in enumerate(rules):
            taken = " AND ".join(f"url NOT IN (SELECT url FROM w{i}_{j})" for j in range(k)) or "true"
            parts += [
                f"f{i}_{k} AS (SELECT * FROM g WHERE law = '{law}' AND {_matches(rule)} AND {taken})",
                f"b{i}_{k} AS (SELECT * FROM f{i}_{k} ORDER BY {date_key('effective_date')} DESC, rank, ord LIMIT 1)",
                f"w{i}_{k} AS (SELECT f.* FROM f{i}_{k} f JOIN b{i}_{k} b ON f.law_id = b.law_id ORDER BY f.rank, f.url, f.ord LIMIT 1)",
            ]
            winners.append(f"SELECT law, {k} AS rule, '{rule['type']}' AS type, ord, law_id FROM w{i}_{k}")
    return f"WITH {LINKS_SQL}, {_GROUPED}, {', '.join(parts)} SELECT *, CAST(row_number() OVER (PARTITION BY law ORDER BY rule) - 1 AS INTEGER) AS place FROM ({' UNION ALL '.join(winners)})"


_PIECES = r"p AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(Điều\s+\d+[.:]\s*.*)', chr(1) || '\1', 'g'), chr(1)) AS pieces FROM laws), a AS (SELECT doc_id, unnest(range(2, len(pieces) + 1)) - 2 AS ord, unnest(pieces[2:]) AS piece FROM p)"
_HEAD = r"regexp_extract(piece, '(?m)^(Điều\s+\d+[.:]\s*.*)', 1)"
_SIZES = "n AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS n FROM laws)"
_CONTRACT = "c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY position, text) AS text FROM clauses GROUP BY conv_id)"
_PARTS = rf"""h AS (SELECT conv_id, text, list_filter(list_transform(string_split(regexp_replace(text, '(?im)^(Điều\s+\d+[.:\-\s])', chr(1) || '\1', 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS by_heading,
  list_filter(list_transform(string_split(regexp_replace(text, '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS by_blank FROM c),
parts AS (SELECT conv_id, text, CASE WHEN len(by_heading) >= 2 THEN by_heading WHEN len(by_blank) > 0 THEN by_blank ELSE [{strip('text')}] END AS parts FROM h)"""
_SCORES = ", ".join(f"CAST(len(list_filter({_list(words)}, lambda w: contains(lower(text), w))) AS INTEGER)" for words in DOMAIN_KEYWORDS.values())
_SECTIONS = """r AS (SELECT conv_id, position, CASE WHEN position % 3 = 0 THEN 'same' ELSE left(text, 1000) END AS result FROM clauses),
sections AS (SELECT conv_id, position, '### Điều khoản ' || position || chr(10) || result || chr(10) AS section
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, md5(left(result, 100)) ORDER BY position) AS k FROM r WHERE result <> '') WHERE k = 1)"""
_JUDGED = """j AS (SELECT conv_id, count(*) AS clauses, count_if(k = 0) AS failed, CAST(sum(CASE k WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS findings, sum(CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS named
  FROM (SELECT conv_id, (conv_id * 3 + position) % 4 AS k FROM clauses) GROUP BY conv_id),
judged AS (SELECT conv_id, clauses, failed, findings, CASE WHEN failed > clauses // 2 THEN 0.0 ELSE coalesce(CAST(named AS DOUBLE) / nullif(findings, 0), 0.0) END AS confidence,
  CASE WHEN failed > clauses // 2 THEN failed || '/' || clauses || ' clauses failed' END AS error FROM j)"""


def _sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?]){WHITE}+', '\1' || chr(1), 'g'), chr(1)), lambda q: {strip('q')}), lambda q: q <> '')"


def _chunks(low: int, high: int, budget: int) -> str:
    """Articles, short ones merged up to ``low`` characters, long groups cut into parts of ``high``, and overlaps of ``budget``."""
    return rf"""
        WITH RECURSIVE {LAWS_SQL}, {_PIECES},
        art AS (SELECT doc_id, ord, {strip('piece')} AS txt, CAST(regexp_extract({_HEAD}, 'Điều\s+(\d+)', 1) AS INTEGER) AS number, {strip(rf"regexp_extract({strip(_HEAD)}, 'Điều\s+\d+[.:]\s*(.*)', 1)")} AS title, 'Chương ' || (ord // 10 + 1) || '. Phần' AS chapter FROM a),
        n AS (SELECT doc_id, list(length(txt) ORDER BY ord) AS n FROM art GROUP BY doc_id),
        r AS (
          SELECT doc_id, 0 AS i, 0 AS grp, 0 AS nxt, false AS op, CAST(0 AS BIGINT) AS total, n FROM n
          UNION ALL
          SELECT doc_id, i + 1, g, CASE WHEN closes THEN g + 1 ELSE g END, NOT closes, CASE WHEN closes THEN 0 ELSE total + n[i + 1] END, n
          FROM (SELECT *, CASE WHEN n[i + 1] >= {low} AND op THEN nxt + 1 ELSE nxt END AS g, n[i + 1] >= {low} OR total + n[i + 1] >= {low} AS closes FROM r WHERE i < len(n))
        ), l AS (SELECT doc_id, op, nxt FROM r WHERE i = len(n)),
        grp AS (SELECT r.doc_id, r.i - 1 AS ord, CASE WHEN l.op AND l.nxt > 0 THEN least(r.grp, l.nxt - 1) ELSE r.grp END AS grp FROM r JOIN l USING (doc_id) WHERE r.i > 0),
        whole AS (SELECT doc_id, grp, min(ord) AS ord, string_agg(txt, chr(10) || chr(10) ORDER BY ord) AS txt, list(number ORDER BY ord) AS nums, CASE WHEN count(*) = 1 THEN min(title) ELSE '' END AS title, arg_min(chapter, ord) AS chapter FROM art JOIN grp USING (doc_id, ord) GROUP BY doc_id, grp),
        cut AS (SELECT art.*, w.grp, string_split(regexp_replace(art.txt, '(?m)^({WHITE}*\d+\.{WHITE}+)', chr(1) || '\1', 'g'), chr(1)) AS c FROM art JOIN grp USING (doc_id, ord) JOIN whole w ON w.doc_id = art.doc_id AND w.grp = grp.grp WHERE length(w.txt) > {high}),
        cl AS (SELECT *, {strip('c[1]')} AS head, list_transform(c[2:], lambda x: {strip('x')}) AS cs FROM cut),
        k AS (
          SELECT doc_id, ord, 0 AS i, 0 AS part, 0 AS items, length(head) AS total, list_transform(cs, lambda x: length(x)) AS n, length(head) AS h FROM cl WHERE len(c) > 2
          UNION ALL
          SELECT doc_id, ord, i + 1, CASE WHEN f THEN part + 1 ELSE part END, CASE WHEN f THEN 1 ELSE items + 1 END, CASE WHEN f THEN h + n[i + 1] ELSE total + n[i + 1] END, n, h FROM (SELECT *, total + n[i + 1] > {high} AND items > 0 AS f FROM k WHERE i < len(n))
        ), parts AS (SELECT k.doc_id, k.ord, k.part, {strip("any_value(head) || chr(10) || string_agg(cs[k.i], chr(10) ORDER BY k.i)")} AS txt, any_value(cl.grp) AS grp, any_value(number) AS number, any_value(title) AS title, any_value(chapter) AS chapter
          FROM k JOIN cl USING (doc_id, ord) WHERE k.i > 0 GROUP BY k.doc_id, k.ord, k.part),
        every AS (
          SELECT doc_id, grp, ord, 0 AS part, 0 AS shown, txt, nums, title, chapter FROM whole WHERE length(txt) <= {high}
          UNION ALL SELECT doc_id, grp, ord, 0, 0, txt, [number], title, chapter FROM cl WHERE len(c) <= 2
          UNION ALL SELECT doc_id, grp, ord, part, CASE WHEN max(part) OVER (PARTITION BY doc_id, ord) > 0 THEN part + 1 ELSE 0 END, txt, [number], title, chapter FROM parts
        ), placed AS (SELECT *, row_number() OVER w - 1 AS position, lag(txt) OVER w AS before FROM every WINDOW w AS (PARTITION BY doc_id ORDER BY grp, ord, part)),
        s AS (SELECT doc_id, position, unnest(range(len(q))) AS i, unnest(q) AS y FROM (SELECT doc_id, position, {_sentences('before')} AS q FROM placed WHERE length(before) > {budget})),
        f AS (SELECT *, sum(length(y)) OVER (PARTITION BY doc_id, position ORDER BY i DESC) AS upto, max(i) OVER (PARTITION BY doc_id, position) AS last FROM s),
        o AS (SELECT doc_id, position, string_agg(y, ' ' ORDER BY i) AS tail FROM f WHERE upto <= {budget} OR i = last GROUP BY doc_id, position),
        made AS (SELECT p.*, CASE WHEN length(before) <= {budget} THEN before ELSE coalesce(tail, right(before, {budget})) END AS lap FROM placed p LEFT JOIN o ON o.doc_id = p.doc_id AND o.position = p.position),
        done AS (SELECT *, CASE WHEN lap <> '' THEN '[...overlap...]' || chr(10) || lap || chr(10) || '[...end overlap...]' || chr(10) || chr(10) || txt ELSE txt END AS text FROM made)
        SELECT doc_id, CAST(position AS INTEGER) AS position, 'ldn2020_dieu_' || printf('%03d', nums[1]) || CASE WHEN len(nums) > 1 THEN '_to_' || printf('%03d', nums[-1]) ELSE '' END || CASE WHEN shown > 0 THEN '_p' || shown ELSE '' END AS chunk_id,
               nums[1] AS article_number, title AS article_title, chapter, CAST(floor(length(text) / 3.5) AS INTEGER) AS estimated_tokens, coalesce(lap <> '', false) AS has_overlap, md5(text) AS text_md5 FROM done"""


def oracle_sql() -> dict[str, str]:
    now = f"TIMESTAMP '{NOW}'"
    recent = f"TRY_CAST(discovered_at AS TIMESTAMP) >= {now} - INTERVAL {s.REFRESH_DAYS} DAY"
    laws_values = ", ".join(f"({i}, '{name}', {_list(words)})" for i, (name, _, words) in enumerate(s.LAWS))
    templates_values = ", ".join(f"({i}, '{x}', '{y}', {z})" for i, (x, y, z) in enumerate(s.TEMPLATES))
    phrases = list(dict.fromkeys([*ARTIFACTS, *map(fold_text, s.BLACKLIST)]))
    best = f"k AS (SELECT {dedup_key('link')} AS dedup_key, *, row_number() OVER (PARTITION BY {dedup_key('link')} ORDER BY length(snippet) DESC, ord) AS r FROM links)"
    valid = f"(text <> '' AND length(text) >= {s.MIN_CHARS} AND {has_any('f', [fold_text(x) for x in s.REQUIRED_KEYWORDS])} AND NOT {has_any('f', [fold_text(x) for x in s.BLACKLIST])})"
    attempts = f"WITH {LINKS_SQL}, a AS (SELECT ord % 100 AS law, ord // 100 AS place, link AS url, ord % 7 = 3 AS success FROM links), f AS (SELECT law, bool_or(success) AS success, coalesce(arg_min(url, place) FILTER (success), arg_min(url, place)) AS url, coalesce(min(place) FILTER (success), 0) AS fallback_level, count(*) AS attempts, CASE WHEN NOT bool_or(success) THEN 'All ' || count(*) || ' URLs failed' END AS error FROM a GROUP BY law)"
    tables = ["documents", "pages", "benchmark", "labels", "conversations", "embeddings", "events"]
    counts = " UNION ALL ".join(f"SELECT '{x}' AS \"table\", count(*) AS n FROM {x}" for x in tables)
    health = f"h AS (SELECT \"table\", n, CASE WHEN n > 0 THEN 'healthy' ELSE 'empty' END AS status FROM ({counts}))"
    entry = "'### Vi phạm ' || i || chr(10) || '- **Điều khoản:** ' || left(clause, 120) || chr(10) || '- **Vi phạm:** v' || chr(10) || '- **Căn cứ pháp lý:** ' || CASE WHEN law = '' THEN '_(chưa xác định)_' ELSE law END || chr(10) || '- **Khuyến nghị sửa đổi:** s' || chr(10)"
    return {
        "law_stats": """
            SELECT source, count(*) AS chunks, CAST(sum(tok) AS BIGINT) AS total_tokens, min(tok) AS min_tokens, max(tok) AS max_tokens, CAST(floor(sum(tok) / count(*)) AS BIGINT) AS avg_tokens,
                   round(CAST(100.0 AS DOUBLE) * count_if(tok BETWEEN 800 AND 1200) / count(*), 1) AS pct_in_range, CAST(count_if(lang = 'en') AS BIGINT) AS chunks_with_overlap, count(DISTINCT source) AS laws
            FROM (SELECT source, lang, CAST(floor(length(coalesce(text, '')) / 3.5) AS INTEGER) AS tok FROM documents) GROUP BY ROLLUP (source)""",
        "article_sort": f"WITH {RECORDS_SQL} SELECT law_id, article_id, CAST(row_number() OVER (PARTITION BY law_id ORDER BY n, article_id) AS INTEGER) AS place FROM (SELECT DISTINCT law_id, article_id, n FROM records)",
        "source_tier_override": """
            SELECT source, CAST(count_if(lang IS DISTINCT FROM 'de') AS BIGINT) AS tier_1, CAST(count_if(lang = 'de') AS BIGINT) AS tier_2, CAST(sum(CASE WHEN lang = 'de' THEN -length(text) ELSE length(text) END) AS BIGINT) AS chars
            FROM documents GROUP BY source""",
        "reconstruct_text": f"WITH {RECORDS_SQL}, t AS (SELECT law_id, string_agg(part, chr(10) || chr(10) ORDER BY n, article_id, part) AS text FROM records GROUP BY law_id) SELECT law_id, CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest FROM t",
        "article_segments": rf"""
            WITH {LAWS_SQL}, {_PIECES}
            SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(regexp_extract({_HEAD}, 'Điều\s+(\d+)', 1) AS INTEGER) AS number, md5({strip(rf"regexp_extract({strip(_HEAD)}, 'Điều\s+\d+[.:]\s*(.*)', 1)")}) AS title_md5,
                   CAST(length({strip('piece')}) AS INTEGER) AS chars, CAST(floor(length({strip('piece')}) / 3.5) AS INTEGER) AS tokens, md5({strip('piece')}) AS text_md5 FROM a""",
        "chapter_asof": rf"WITH {LAWS_SQL}, {_PIECES} SELECT doc_id, number, 'Chương ' || ((number - 1) // 10 + 1) || '. Phần' AS chapter FROM (SELECT doc_id, CAST(regexp_extract({_HEAD}, 'Điều\s+(\d+)', 1) AS INTEGER) AS number FROM a)",
        "merge_short": f"""
            WITH RECURSIVE {LAWS_SQL}, {_SIZES}, r AS (
              SELECT doc_id, 0 AS i, 0 AS grp, 0 AS nxt, false AS op, CAST(0 AS BIGINT) AS total, n FROM n
              UNION ALL
              SELECT doc_id, i + 1, g, CASE WHEN closes THEN g + 1 ELSE g END, NOT closes, CASE WHEN closes THEN 0 ELSE total + n[i + 1] END, n
              FROM (SELECT *, CASE WHEN n[i + 1] >= 200 AND op THEN nxt + 1 ELSE nxt END AS g, n[i + 1] >= 200 OR total + n[i + 1] >= 200 AS closes FROM r WHERE i < len(n))
            ), l AS (SELECT doc_id, op, nxt FROM r WHERE i = len(n))
            SELECT r.doc_id, r.i - 1 AS ord, CASE WHEN l.op AND l.nxt > 0 THEN least(r.grp, l.nxt - 1) ELSE r.grp END AS group_no FROM r JOIN l ON r.doc_id = l.doc_id WHERE r.i > 0""",
        "pack_clauses": f"""
            WITH RECURSIVE {LAWS_SQL}, {_SIZES}, r AS (
              SELECT doc_id, 0 AS i, 0 AS part, 0 AS items, CAST(25 AS BIGINT) AS total, n FROM n
              UNION ALL
              SELECT doc_id, i + 1, CASE WHEN f THEN part + 1 ELSE part END, CASE WHEN f THEN 1 ELSE items + 1 END, CASE WHEN f THEN 25 + n[i + 1] ELSE total + n[i + 1] END, n
              FROM (SELECT *, total + n[i + 1] > 300 AND items > 0 AS f FROM r WHERE i < len(n))
            ) SELECT doc_id, i - 1 AS ord, part FROM r WHERE i > 0""",
        "chunk_pipeline": _chunks(280, 560, 70),
        "chunk_overlap_lag": rf"""
            WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
            b AS (SELECT doc_id, ord, lag(line) OVER (PARTITION BY doc_id ORDER BY ord) AS x FROM l),
            s AS (SELECT doc_id, ord, unnest(range(len(p))) AS i, unnest(p) AS y FROM (SELECT doc_id, ord, {_sentences('x')} AS p FROM b WHERE length(x) > 40)),
            c AS (SELECT *, sum(length(y)) OVER (PARTITION BY doc_id, ord ORDER BY i DESC) AS upto, max(i) OVER (PARTITION BY doc_id, ord) AS last FROM s),
            j AS (SELECT doc_id, ord, string_agg(y, ' ' ORDER BY i) AS t FROM c WHERE upto <= 40 OR i = last GROUP BY doc_id, ord)
            SELECT b.doc_id, CAST(b.ord AS INTEGER) AS ord, md5(CASE WHEN length(x) <= 40 THEN x ELSE coalesce(t, right(x, 40)) END) AS overlap_md5 FROM b LEFT JOIN j ON b.doc_id = j.doc_id AND b.ord = j.ord""",
        "chunk_ids": """
            SELECT doc_id, 'ldn2020_' || CASE WHEN doc_id % 2000 > 0 THEN 'dieu_' || printf('%03d', doc_id % 2000) || CASE WHEN doc_id % 3 > 0 THEN '_to_' || printf('%03d', doc_id % 2000 + doc_id % 3) ELSE '' END
                   || CASE WHEN doc_id % 4 > 0 THEN '_p' || (doc_id % 4) ELSE '' END ELSE 'chunk_' || printf('%04d', doc_id + 1) END AS chunk_id FROM documents""",
        "document_prefix": "SELECT doc_id, ['blds2015', 'lttm2010', 'ltm', 'lno2023', 'lkdbds', 'blld2019'][doc_id % 6 + 1] AS prefix FROM documents",
        "chunk_nested_projection": rf"""
            WITH {LAWS_SQL}, {_PIECES}, n AS (SELECT doc_id, ord, {strip('piece')} AS piece, {_HEAD} AS head, lag({strip('piece')}) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM a),
            h AS (SELECT doc_id, ord, piece, CAST(regexp_extract(head, 'Điều\s+(\d+)', 1) AS INTEGER) AS number, {strip(r"regexp_extract(" + strip('head') + r", 'Điều\s+\d+[.:]\s*(.*)', 1)")} AS title, coalesce({_sentences('before')}[-1], '') AS o FROM n)
            SELECT doc_id, CAST(ord AS INTEGER) AS position, CAST(to_json({{'law_id': doc_id, 'article_number': number, 'article_title': title, 'chapter': 'Chương ' || (ord // 10 + 1) || '. Phần', 'section': '',
                   'estimated_tokens': CAST(floor((length(piece) + CASE WHEN o <> '' THEN length(o) + length('[...overlap...].') + length('.[...end overlap...]..') ELSE 0 END) / 3.5) AS INTEGER), 'has_overlap': o <> ''}}) AS VARCHAR) AS metadata_json FROM h""",
        "fold_text": f"SELECT doc_id, md5({fold('text')}) AS digest FROM documents",
        "text_counts": r"SELECT doc_id, CAST(floor(length(text) / 3.5) AS INTEGER) AS tokens, CAST(length(text) AS INTEGER) AS chars, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words FROM documents",
        "clean_lines": rf"""
            WITH l AS (SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS raw FROM (SELECT doc_id, string_split(replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(160), ' '), chr(10)) AS x FROM documents)),
            m AS (SELECT doc_id, k, regexp_replace({strip('raw')}, '[ \t]+', ' ', 'g') AS x FROM l),
            f AS (SELECT *, {fold('x')} AS f FROM m),
            c AS (SELECT * FROM f WHERE x = '' OR NOT (length(f) < 3 OR {has_any('f', phrases)} OR (starts_with(f, 'tai ve') AND length(f) < 120))),
            w AS (SELECT doc_id, k, x FROM (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM c WHERE x <> '') WHERE before IS NULL OR before <> x UNION ALL SELECT doc_id, k, x FROM c WHERE x = ''),
            j AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY k) AS t FROM w GROUP BY doc_id)
            SELECT d.doc_id, md5({strip(r"regexp_replace(regexp_replace(coalesce(t, ''), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')")}) AS digest FROM documents d LEFT JOIN j USING (doc_id)""",
        "validate_content": f"WITH {LAWS_SQL}, v AS (SELECT doc_id, text, {fold('text')} AS f FROM laws) SELECT doc_id, {valid} AS valid, {has_any('f', STRUCTURE)} AS structured FROM v",
        "safe_names": rf"SELECT doc_id, md5(replace({strip(r"regexp_replace(text, '[^\p{L}\p{N}\p{M}_\s-]', '', 'g')")}, ' ', '_')) AS name_md5 FROM documents",
        "url_domain": f"WITH {LINKS_SQL} SELECT ord, {domain('link')} AS domain, {path('link')} AS path FROM links",
        "url_dedup_key": f"WITH {LINKS_SQL} SELECT ord, {dedup_key('link')} AS dedup_key FROM links",
        "allowlist_filter": f"WITH {LINKS_SQL} SELECT ord, link FROM links WHERE {_ALLOWED}",
        "denylist_filter": f"WITH {LINKS_SQL} SELECT ord, link FROM links WHERE NOT {has_any('link', s.DENIED)}",
        "name_match_filter": f"WITH {LINKS_SQL} SELECT ord, title FROM links WHERE {has_any(fold(_BOTH), [fold_text(x) for x in (s.LAWS[1][0], *s.LAWS[1][1])])}",
        "law_id_extract": f"WITH {LINKS_SQL} SELECT ord, {law_id(_BOTH)} AS law_id, {law_id(_BOTH, LAW_ID_ON_PAGE)} AS page_law_id FROM links",
        "date_extract": f"WITH {LINKS_SQL} SELECT ord, {effective_date(_BOTH)} AS effective_date FROM links",
        "task_plan": f"""
            WITH l(ord, name, keywords) AS (VALUES {laws_values}), t(sub, id, template, priority) AS (VALUES {templates_values}),
            u AS (SELECT ord, sub, 0 AS kind, replace(template, '{{law_name}}', name) AS query, id AS query_id, priority, name FROM l, t
                  UNION ALL SELECT ord, unnest(range(len(keywords))), 1, unnest(keywords), 'keyword', 2, name FROM l)
            SELECT CAST(row_number() OVER (ORDER BY priority, ord, kind, sub) AS INTEGER) AS task, query, query_id, priority, name AS target_law_name FROM u""",
        "found_links": f"""
            WITH {LINKS_SQL} SELECT link AS url, CASE WHEN title = '' THEN 'No Title' ELSE title END AS title, snippet, {domain('link')} AS source_domain, {law_id(_BOTH)} AS law_id, {effective_date(_BOTH)} AS effective_date, {_rank(domain('link'))} AS source_rank, ord
            FROM links WHERE link <> '' AND {_ALLOWED} AND NOT {has_any('link', s.DENIED)} AND {has_any(fold(_BOTH), _NAMES)}""",
        "batch_dedup": f"WITH {LINKS_SQL}, {best} SELECT dedup_key, ord, snippet FROM k WHERE r = 1",
        "history_antijoin": f"WITH {LINKS_SQL}, {best} SELECT dedup_key, ord FROM k WHERE r = 1 AND dedup_key NOT IN (SELECT {dedup_key('link')} FROM links WHERE lower(title) LIKE '%doanh%' AND {recent})",
        "history_diagnostics": f"WITH {LINKS_SQL}, h AS (SELECT TRY_CAST(discovered_at AS TIMESTAMP) AS t, coalesce({recent}, false) AS r FROM links) SELECT count(*) AS links, CAST(count_if(r) AS BIGINT) AS recent, CAST(count_if(t IS NOT NULL AND NOT r) AS BIGINT) AS stale, CAST(count_if(t IS NULL) AS BIGINT) AS unreadable FROM h",
        "mark_processed": f"""
            WITH {LINKS_SQL}, q AS (SELECT ord, link, CASE ord % 5 WHEN 0 THEN true WHEN 1 THEN false END AS p, link IN (SELECT link FROM links WHERE ord % 3 = 0) AS done FROM links)
            SELECT ord, coalesce(p, false) OR done AS is_processed, done AND NOT coalesce(p, false) AS updated, done AND NOT coalesce(p, false) AS stamped FROM q""",
        "stream_dedup": f"""
            WITH {LINKS_SQL}, k AS (SELECT {dedup_key('link')} AS dedup_key, TRY_CAST(discovered_at AS TIMESTAMP) AS ts FROM links), u AS (SELECT DISTINCT dedup_key, ts, coalesce(epoch(ts), -1e12) AS x FROM k),
            b AS (SELECT *, lag(x) OVER (PARTITION BY dedup_key ORDER BY x) AS before FROM u)
            SELECT dedup_key, strftime(ts, '%Y-%m-%d') AS day FROM b WHERE before IS NULL OR x - before > {s.REFRESH_DAYS} * 86400""",
        "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "canonical_law_match": f"WITH {LINKS_SQL}, {_GROUPED} SELECT ord, law FROM g WHERE law IS NOT NULL",
        "unmatched_links": f"WITH {LINKS_SQL}, {_GROUPED} SELECT ord, url FROM g WHERE law IS NULL",
        "law_groups": f"WITH {LINKS_SQL}, {_GROUPED} SELECT law, CAST(count(*) AS INTEGER) AS n, arg_min(url, ord) AS first_url, arg_max(url, ord) AS last_url FROM g WHERE law IS NOT NULL GROUP BY law",
        "fallback_chain": f"""
            WITH {LINKS_SQL}, {_GROUPED}, f AS (SELECT * FROM g WHERE law IS NOT NULL AND NOT contains(coalesce(law_id, ''), 'QH15'))
            SELECT law, true AS success, CASE law WHEN 'Luật Doanh nghiệp' THEN 1 ELSE 0 END AS fallback_level, CASE law WHEN 'Luật Doanh nghiệp' THEN 2 WHEN 'Bộ luật Dân sự' THEN 1 ELSE count(*) END AS attempts, CAST(NULL AS VARCHAR) AS error FROM f GROUP BY law""",
        "source_alias_rank": f"WITH {LINKS_SQL} SELECT ord, CASE {domain('link')} WHEN 'congbao.chinhphu.vn' THEN 0 WHEN 'thuvienphapluat.vn' THEN 1 ELSE 2 END AS rank FROM links",
        "task_results": f"""
            WITH {LINKS_SQL}, k AS (SELECT {dedup_key('link')} AS dedup_key, CAST(ord % 10 AS INTEGER) AS task, ord, row_number() OVER (PARTITION BY {dedup_key('link')} ORDER BY ord % 2, ord % 10, length(snippet) DESC, ord) AS r FROM links)
            SELECT dedup_key, task, ord FROM k WHERE r = 1""",
        "discovery_totals": f"WITH {LINKS_SQL} SELECT count(*) AS raw, count(DISTINCT {dedup_key('link')}) AS saved FROM links",
        "updated_count": f"WITH {LINKS_SQL} SELECT count(*) AS links, CAST(count_if(link IN (SELECT link FROM links WHERE ord % 3 = 0) AND ord % 5 > 0) AS BIGINT) AS updated FROM links",
        "content_hashes": f"WITH {LINKS_SQL} SELECT ord, md5(lower(trim(title)) || ' ' || lower(trim(snippet))) AS hash FROM links",
        "output_files": f"WITH {LINKS_SQL} SELECT ord, CASE WHEN title = '' THEN 'luat_nha_o.json' ELSE replace({fold('title')}, ' ', '_') || '.json' END AS file FROM links",
        "heading_listing": rf"""
            WITH {LAWS_SQL}, p AS (SELECT doc_id, left(text, 2000) AS x FROM laws),
            l AS (SELECT doc_id, unnest(range(len(string_split(x, chr(10))))) AS i, unnest(string_split(x, chr(10))) AS line FROM p),
            o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS place, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM l)
            SELECT doc_id, CASE WHEN starts_with(line, 'Đ') THEN 'article' ELSE 'chapter' END AS kind, CAST(place AS INTEGER) AS place, md5({strip('line')}) AS heading_md5
            FROM o WHERE regexp_matches(line, '^Điều\s+\d+[.:]') OR regexp_matches(line, '^Chương\s+[IVXLCDM\d]+')""",
        "document_log": """
            WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), t AS (SELECT doc_id, CAST(floor(length(line) / 3.5) AS INTEGER) AS tok, starts_with(line, 'T') AS flag FROM l)
            SELECT doc_id, count(*) AS chunks, min(tok) AS min_tokens, max(tok) AS max_tokens, CAST(sum(tok) // count(*) AS BIGINT) AS avg_tokens, CAST(100 * count_if(tok BETWEEN 20 AND 100) // count(*) AS BIGINT) AS pct_in_range, CAST(count_if(flag) AS BIGINT) AS overlaps FROM t GROUP BY doc_id""",
        "embedding_norms": r"SELECT item_id, 384 AS dimensions, CASE WHEN regexp_matches(text, '\S') THEN 1.0 ELSE 0.0 END AS length FROM benchmark",
        "html_extract": f"WITH {LAW_PAGES_SQL} SELECT i AS page_id, CASE kind WHEN 0 THEN CASE WHEN x = '' THEN 'b' ELSE x || chr(10) || 'b' END WHEN 2 THEN CASE WHEN x = '' THEN '' ELSE x || chr(10) END || 'kept' || chr(10) || 'c' WHEN 3 THEN x END AS content FROM law_pages",
        "page_metadata": f"WITH {LAW_PAGES_SQL} SELECT i AS page_id, title AS page_title, law AS page_law_id, published AS published_at, effective AS page_effective_date FROM meta",
        "metadata_backfill": f"WITH {LAW_PAGES_SQL} SELECT i AS page_id, coalesce(nullif(link_law, ''), law, 'unknown') AS law_id, coalesce(effective, link_date) AS effective_date FROM meta",
        "clean_fields": "SELECT item_id, trim(regexp_replace(trim(regexp_replace(text, '[^a-zA-Z ]', '', 'g')), ' +', ' ', 'g') || ' & tail') || chr(10) || chr(10) || 'end' AS text FROM benchmark",
        "whole_context": f"WITH {CONTRACTS_SQL}, {_SECTIONS} SELECT conv_id, md5(string_agg(section, chr(10) ORDER BY position)) AS context_md5 FROM sections GROUP BY conv_id",
        "section_split": f"WITH {CONTRACTS_SQL}, {_SECTIONS} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY position) - 1 AS INTEGER) AS pos, md5(left({strip('section')}, 3000)) AS section_md5 FROM sections",
        "parsed_answers": f"WITH {CONTRACTS_SQL} SELECT conv_id, position, CASE WHEN conv_id % 4 = 0 THEN 'Lao động' ELSE 'Thương mại' END AS domain, CASE WHEN conv_id % 4 = 0 THEN 2 ELSE 0 END AS n_clauses FROM clauses",
        "prompt_filling": f"WITH {CONTRACTS_SQL} SELECT conv_id, position, md5('Clause ' || text || ' under {{clause}}: ' || text) AS prompt_md5 FROM clauses",
        "graph_health": """SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM lineitem) AS edges, '{"id":"p' || (SELECT min(CAST(p_partkey AS VARCHAR)) FROM part) || '","label":"part"}' AS sample""",
        "priority_rule_match": f"WITH {LINKS_SQL}, {_GROUPED} " + " UNION ALL ".join(f"SELECT ord, law, {k} AS rule FROM g WHERE law = '{law}' AND {_matches(rule)}" for law, rules in s.RULES.items() for k, rule in enumerate(rules)),
        "priority_chain": _chain(),
        "auto_prioritize": f"""
            WITH {LINKS_SQL}, {_GROUPED}, x AS (SELECT *, law || '/' || (ord % 50) AS l2, contains(upper(coalesce(law_id, '')), 'VBHN') AS v FROM g WHERE law IS NOT NULL)
            SELECT l2 AS law, CAST(row_number() OVER (PARTITION BY l2 ORDER BY v DESC, {date_key('effective_date', '1900-01-01')} DESC, rank, ord) - 1 AS INTEGER) AS place,
                   CASE WHEN v THEN 'VBHN' WHEN contains(lower(title), 'sửa đổi') THEN 'AMENDMENT' ELSE 'ORIGINAL' END AS type, ord FROM x""",
        "first_success": f"{attempts} SELECT law, success, url, fallback_level, attempts, error FROM f",
        "run_summary": f"{attempts} SELECT CAST(count_if(success) AS BIGINT) AS success_count, CAST(count_if(NOT success) AS BIGINT) AS fail_count, count(*) AS group_count FROM f",
        "html_title": rf"""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title(\s[^>]*)?>(.*?)</title\s*>') THEN {_plain(r"regexp_extract(html, '(?is)<title(\s[^>]*)?>(.*?)</title\s*>', 2)")}
            WHEN regexp_matches(html, '(?is)<h1(\s[^>]*)?>(.*?)</h1\s*>') THEN {_plain(r"regexp_extract(html, '(?is)<h1(\s[^>]*)?>(.*?)</h1\s*>', 2)")} END AS title FROM pages""",
        "scraped_content": rf"""
            WITH {LAWS_SQL}, t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN '' ELSE text END AS text FROM laws), v AS (SELECT doc_id, text, {fold('text')} AS f FROM t),
            e AS (SELECT *, CASE WHEN doc_id % 10 = 1 THEN 'fetch failed' WHEN doc_id % 10 = 2 THEN 'no content' WHEN NOT {valid} THEN 'validation failed' END AS error FROM v)
            SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'Tên' ELSE 'Unknown' END AS title, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'unknown' END AS law_id, CAST(length(text) AS INTEGER) AS char_count, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS word_count,
                   {has_any('f', STRUCTURE)} AS has_structure, error IS NULL AS success, error FROM e""",
        "domain_classify": f"""
            WITH {CONTRACTS_SQL}, {_CONTRACT}, {_PARTS}, sc AS (SELECT conv_id, parts, [{_SCORES}] AS sc FROM parts WHERE conv_id % 50 <> 7), o AS (SELECT *, list_reverse_sort(sc) AS o FROM sc)
            SELECT conv_id, CASE WHEN o[1] >= 2 AND o[1] >= 2 * o[2] THEN {_list(list(DOMAIN_KEYWORDS))}[list_position(sc, o[1])] ELSE '{DEFAULT_DOMAIN}' END AS domain, CAST(len(parts) AS INTEGER) AS n_clauses, CAST(NULL AS VARCHAR) AS error FROM o
            UNION ALL SELECT conv_id, NULL, NULL, 'contract is empty' FROM c WHERE conv_id % 50 = 7""",
        "clause_split": f"WITH {CONTRACTS_SQL}, {_CONTRACT}, {_PARTS} SELECT conv_id, CAST(unnest(range(len(parts))) AS INTEGER) AS pos, md5(unnest(parts)) AS clause_md5 FROM parts",
        "vector_topk": """
            WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS found_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS x FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, found_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, found_id) AS rank FROM p) WHERE rank <= 5""",
        "context_dedup": f"WITH {CONTRACTS_SQL}, {_SECTIONS} SELECT conv_id, position, md5(section) AS section_md5 FROM sections",
        "positional_context_join": f"""
            WITH {CONTRACTS_SQL}, {_SECTIONS}, x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY position) AS position, left({strip('section')}, 3000) AS context FROM sections)
            SELECT c.conv_id, c.position, md5(coalesce(context, '')) AS context_md5 FROM clauses c LEFT JOIN x ON c.conv_id = x.conv_id AND c.position = x.position""",
        "finding_required_keys": f"WITH {CONTRACTS_SQL} SELECT conv_id, position, 'c' AS clause, 'v' AS violation, CAST(position % 3 AS VARCHAR) AS reference_law, 's' AS suggested_fix FROM clauses WHERE (conv_id + position) % 5 < 3",
        "confidence_score": f"WITH {CONTRACTS_SQL}, {_JUDGED} SELECT conv_id, clauses, CAST(failed AS BIGINT) AS failed, findings, confidence, error FROM judged",
        "template_report": f"""
            WITH {CONTRACTS_SQL}, {_JUDGED}, f AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY position) AS i, text AS clause, CASE WHEN position % 2 = 0 THEN 'L' ELSE '' END AS law FROM clauses WHERE role = 'assistant'),
            d AS (SELECT conv_id, count(*) AS k, string_agg({entry}, chr(10) ORDER BY i) AS details FROM f GROUP BY conv_id),
            r AS (SELECT j.conv_id, '# Báo cáo Kiểm toán Hợp đồng' || chr(10) || chr(10) || '## Tóm tắt' || chr(10) || chr(10) ||
              CASE WHEN error IS NOT NULL THEN '**Lỗi pipeline:** ' || error WHEN k IS NULL THEN 'Không phát hiện vi phạm nào. _(Lưu ý: đang chạy ở chế độ STUB — cần OPENAI_API_KEY để phân tích thực sự)_'
                   ELSE 'Đã kiểm tra **' || clauses || '** điều khoản, phát hiện **' || k || '** mục cần xem xét' || CASE WHEN confidence = 0 THEN ' _(STUB — cần OPENAI_API_KEY)_' ELSE '' END || '.' END
              || chr(10) || chr(10) || '## Chi tiết vi phạm' || chr(10) || chr(10) || coalesce(details, '_(Không có vi phạm nào được phát hiện)_') || chr(10) || '## Khuyến nghị chung' || chr(10) || chr(10)
              || '_(Xem chi tiết từng vi phạm ở trên. Cần OPENAI_API_KEY để có khuyến nghị tổng hợp từ AI.)_' || chr(10) || chr(10) || '---' || chr(10)
              || '*Lĩnh vực: **Dân sự** | Điểm tin cậy: ' || printf('%.2f', confidence) || ' | Điều khoản: ' || clauses || ' | Vi phạm: ' || coalesce(k, 0) || ' | 2026-01-15 00:00 UTC*' AS t
              FROM judged j LEFT JOIN d ON j.conv_id = d.conv_id)
            SELECT conv_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS report_md5 FROM r""",
        "catalog_counts": f'WITH {health} SELECT "table", n, status FROM h',
        "overall_health": f"WITH {health} SELECT count(*) AS stores, CAST(sum(n) AS BIGINT) AS records, bool_and(status = 'healthy') AS healthy FROM h",
        "label_histogram": "SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 10",
        "vector_collections": "SELECT label, count(*) AS points, CAST(max(len(embedding)) AS INTEGER) AS dimensions FROM embeddings GROUP BY ROLLUP (label)",
    }
