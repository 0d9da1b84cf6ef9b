"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from docsheaf.functions.text import MARKS, STRIP, WS, char_class
from docsheaf.sources.fixtures import FILENAMES, HEADERS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


def case(column: str, names: dict) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


META = """meta AS (SELECT doc_id, 400 + (doc_id * 7919) % 3200 AS width, 400 + (n_chars * 31 + doc_id) % 4800 AS height,
 CAST([1, 3, 4][CAST(doc_id % 3 AS INT) + 1] AS BIGINT) AS channels FROM documents),
dpi AS (SELECT *, CAST(least(greatest(trunc(s / CASE WHEN r > 1.35 AND r < 1.50 THEN 8.27 WHEN r > 1.25 AND r < 1.35 THEN 8.5 ELSE 8.0 END), 72), 600) AS BIGINT) AS dpi
 FROM (SELECT *, least(width, height) AS s, greatest(width, height)::DOUBLE / least(width, height)::DOUBLE AS r FROM meta))"""


def chunks(columns: int) -> str:
    return f"""chunk AS (SELECT doc_id, i AS idx, i // {columns} AS r, i % {columns} AS c, substring(text, i * 480 + 1, 600) AS text
 FROM (SELECT doc_id, text, unnest(range(0, greatest(0, CAST(ceil((n_chars - 120) / 480.0) AS BIGINT) - 1) + 1)) AS i FROM documents))"""


INK = f"""line AS (SELECT doc_id, n - 1 AS n, length(regexp_replace(l, '{WS}', '', 'g')) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)),
sized AS (SELECT doc_id, n, k, 16 + (n * 7 + doc_id) % 30 AS r FROM line),
placed AS (SELECT *, 20 + coalesce(CAST(sum(r) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS y0 FROM sized),
ink AS (SELECT doc_id, y0 + j AS y, CASE WHEN j < 12 THEN k ELSE 0 END AS ink FROM (SELECT *, unnest(range(0, r)) AS j FROM placed)
 UNION ALL SELECT doc_id, j AS y, 0 AS ink FROM (SELECT doc_id, unnest(range(0, 20)) AS j FROM placed WHERE n = 0)),
smooth AS (SELECT doc_id, y, CAST(sum(ink) OVER (PARTITION BY doc_id ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS window_ink, CAST(max(ink) OVER (PARTITION BY doc_id) AS BIGINT) AS top FROM ink)"""

VALUE = "round(CASE WHEN top > 0 THEN window_ink / (top * 5.0::DOUBLE) ELSE 0.0 END, 6)"

GAPS = f"""{INK},
low AS (SELECT *, CASE WHEN top > 0 THEN window_ink < 0.25::DOUBLE * top ELSE true END AS low, count(*) OVER (PARTITION BY doc_id) AS size FROM smooth),
island AS (SELECT doc_id, y, size, y - row_number() OVER (PARTITION BY doc_id ORDER BY y) AS g FROM low WHERE low),
run AS (SELECT doc_id, min(y) AS a, count(*) AS w, max(size) AS size FROM island GROUP BY doc_id, g HAVING min(y) + count(*) < max(size)),
gap AS (SELECT doc_id, a + w // 2 AS center, size FROM run WHERE w >= 10 AND (a + w // 2) * 10 > size AND (a + w // 2) * 10 < size * 9),
pos AS (SELECT doc_id, list_sort(list(center)) AS g, max(size) AS size FROM gap GROUP BY doc_id)"""

EVENTS = """e AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) // 20 AS us, (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ()) // 20 AS now_us FROM events)"""
JOBS = f"""{EVENTS},
j AS (SELECT user_id AS job_id, event_id, us, now_us, {case("event_type", {"signup": "pending", "view": "processing", "purchase": "completed", "error": "failed"})} AS status,
 CASE WHEN event_type = 'error' THEN 'E' || event_id END AS error FROM e WHERE event_type <> 'click'),
latest AS (SELECT job_id, arg_max(status, (us, event_id)) AS status, max(us) AS updated_us, arg_max(error, (us, event_id)) FILTER (error IS NOT NULL) AS error, max(now_us) AS now_us FROM j GROUP BY job_id)"""
MODELS = f"""{EVENTS},
m AS (SELECT user_id, event_id, us, now_us, ['qari', 'got', 'deepseek'][CAST(user_id % 3 AS INT) + 1] AS model, {case("event_type", {"signup": "not_found", "view": "downloading", "purchase": "ready", "error": "failed", "click": "loading"})} AS status,
 CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS progress, event_type = 'click' AS locks FROM e)"""

UPLOADS = f"""up AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE n_chars * 40000 END AS size_bytes, {list(HEADERS)!r}[CAST(doc_id % 12 AS INT) + 1] AS hex, {list(FILENAMES)!r}[CAST(doc_id % 9 AS INT) + 1] AS filename, 60 + (doc_id * 13) % 600 AS dpi FROM documents),
kind AS (SELECT *, CASE WHEN starts_with(hex, 'FFD8FF') OR starts_with(hex, '89504E470D0A1A0A') OR starts_with(hex, '474946383761') OR starts_with(hex, '474946383961') OR starts_with(hex, '424D') OR starts_with(hex, '49492A00') OR starts_with(hex, '4D4D002A') OR (starts_with(hex, '52494646') AND substring(hex, 17, 8) = '57454250') THEN 'image'
 WHEN starts_with(hex, '255044462D') THEN 'pdf' ELSE 'unknown' END AS kind FROM up)"""

PAGES = """page AS (SELECT conv_id AS job_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_number, count(*) OVER (PARTITION BY conv_id) AS total_pages, text,
 CASE WHEN role = 'system' THEN '' ELSE text END AS formatted_text, length(text) % 100 AS conf FROM conversations)"""


def check(expected: str, mb: int) -> str:
    return f"""CASE WHEN size_bytes = 0 THEN 'File is empty' WHEN size_bytes > {mb} * 1048576 THEN 'File too large: ' || CAST(CAST(round(size_bytes / 1048576.0::DOUBLE, 1) AS DECIMAL(20, 1)) AS VARCHAR) || 'MB (max {mb}MB)'
 WHEN kind = 'unknown' THEN 'Unknown or unsupported file type' WHEN kind <> '{expected}' THEN 'File type mismatch: expected {expected}, detected ' || kind ELSE 'ok' END"""


def merged(columns: int, text: str = "text", rtl: bool = False) -> str:
    """The fold of chunk texts as a recursion over the reading order. Right to left, marks do not
    count for the overlap and the cut is behind its last other character."""
    marks = char_class(MARKS)
    plain = lambda x: f"regexp_replace({x}, '{marks}', '', 'g')" if rtl else x
    letters = "string_split(left(t, 500), '')"
    cut = f"list_filter(range(1, len({letters}) + 1), lambda i: NOT regexp_matches({letters}[i], '{marks}'))[ov]" if rtl else "ov"
    return f"""WITH RECURSIVE {chunks(columns)},
o AS (SELECT doc_id, r, c, {strip(text)} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY r, c) AS k, count(*) OVER (PARTITION BY doc_id) AS n, lag(r) OVER (PARTITION BY doc_id ORDER BY r, c) AS r0, lag(c) OVER (PARTITION BY doc_id ORDER BY r, c) AS c0 FROM chunk),
f AS (SELECT doc_id, k, n, t AS prev, CASE WHEN t = '' THEN []::VARCHAR[] ELSE [t] END AS parts FROM o WHERE k = 1
 UNION ALL SELECT doc_id, k, n, CASE WHEN t = '' THEN prev WHEN fresh THEN t WHEN rest <> '' THEN t ELSE prev END, CASE WHEN t = '' THEN parts WHEN fresh THEN list_append(parts, t) WHEN rest <> '' THEN list_append(parts, rest) ELSE parts END
 FROM (SELECT *, CASE WHEN ov >= 10 THEN {strip(f"substring(t, {cut} + 1)")} ELSE t END AS rest FROM (SELECT *, coalesce(list_max(list_filter(range(10, least(length(pa), length(pb)) + 1), lambda n: right(pa, n) = left(pb, n))), 0) AS ov FROM (SELECT f.doc_id, o.k, f.n, f.prev, f.parts, o.t, f.prev = '' OR NOT ((o.r = o.r0 AND abs(o.c - o.c0) = 1) OR (abs(o.r - o.r0) = 1 AND o.c = o.c0)) AS fresh, {plain("right(f.prev, 500)")} AS pa, {plain("left(o.t, 500)")} AS pb FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1))))
SELECT doc_id, {strip("array_to_string(parts, chr(10) || chr(10))")} AS merged FROM f WHERE k = n"""


def formatted(order: str) -> str:
    return f"""WITH {chunks(2)} SELECT doc_id, string_agg('[Chunk ' || idx || ': Row ' || r || ', Col ' || c || ']' || chr(10) || s, chr(10) || chr(10) ORDER BY r, {order}) AS text
 FROM (SELECT *, {strip("text")} AS s FROM chunk) WHERE s <> '' GROUP BY doc_id"""


def sections(order: str) -> str:
    return f"""WITH {chunks(1)}, s AS (SELECT doc_id, idx, {strip("text")} AS t FROM chunk), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS p FROM s WHERE t <> ''),
q AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM k)
SELECT doc_id, CASE WHEN max(n) = 1 THEN any_value(t) ELSE string_agg('--- Section ' || i || ' ---' || chr(10) || t, chr(10) || chr(10) ORDER BY i) END AS text FROM q GROUP BY doc_id"""


def grids(target: int, max_dim: int, mp: float) -> str:
    e = min(target, max_dim)
    up = lambda a, b: f"CAST(ceil({a} / {b}::DOUBLE) AS BIGINT)"
    return f"""WITH {META}, g AS (SELECT doc_id, width, height, greatest({up("height", e)}, k) AS r, greatest({up("width", e)}, k) AS c
 FROM (SELECT *, CASE WHEN width * height / 1000000.0::DOUBLE > {mp}::DOUBLE THEN CAST(ceil(sqrt(ceil(width * height / 1000000.0::DOUBLE / {mp}::DOUBLE))) AS BIGINT) ELSE 1 END AS k FROM meta)),
grid AS (SELECT doc_id, width, height, p AS prefer_horizontal, CASE WHEN p AND c > 1 AND r * c <= 4 THEN r * c WHEN p AND c > 1 THEN CAST(ceil(r * c / least(c, 2)::DOUBLE) AS BIGINT) ELSE r END AS rows,
 CASE WHEN p AND c > 1 AND r * c <= 4 THEN 1 WHEN p AND c > 1 THEN least(c, 2) ELSE c END AS cols FROM g, (VALUES (false), (true)) v(p))"""


SUGGESTED = f"""WITH {META}, s AS (SELECT *, CAST(ceil(width * height / 1000000.0::DOUBLE) AS BIGINT) AS t, width / height::DOUBLE AS a, width * height / 1000000.0::DOUBLE > 2.0 OR width > 2048 OR height > 2048 AS need FROM meta),
k AS (SELECT *, CAST(ceil(sqrt(t)) AS BIGINT) AS root, least(4, CAST(ceil(sqrt(t * a)) AS BIGINT)) AS wide, least(4, CAST(ceil(sqrt(t / a)) AS BIGINT)) AS tall FROM s),
grid AS (SELECT doc_id, width, height, CAST(CASE WHEN NOT need THEN 1 WHEN a > 1.5 THEN ceil(t / wide::DOUBLE) WHEN a < 0.67 THEN tall ELSE root END AS BIGINT) AS rows, CAST(CASE WHEN NOT need THEN 1 WHEN a > 1.5 THEN wide WHEN a < 0.67 THEN ceil(t / tall::DOUBLE) ELSE root END AS BIGINT) AS cols FROM k)"""

TILES = grids(1536, 2560, 2.5) + """, t AS (SELECT *, height / rows::DOUBLE AS bh, width / cols::DOUBLE AS bw FROM (SELECT *, unnest(range(0, cols)) AS c FROM (SELECT *, unnest(range(0, rows)) AS r FROM grid WHERE prefer_horizontal))),
o AS (SELECT *, CASE WHEN r > 0 THEN oy ELSE 0 END AS ot, CASE WHEN r < rows - 1 THEN oy ELSE 0 END AS ob, CASE WHEN c > 0 THEN ox ELSE 0 END AS ol, CASE WHEN c < cols - 1 THEN ox ELSE 0 END AS orr FROM (SELECT *, CAST(trunc(bh * 0.5) AS BIGINT) AS oy, CAST(trunc(bw * 0.5) AS BIGINT) AS ox FROM t)),
b AS (SELECT *, greatest(0, CAST(trunc(r * bh) AS BIGINT) - ot) AS y0, least(height, CAST(trunc((r + 1) * bh) AS BIGINT) + ob) AS y1, greatest(0, CAST(trunc(c * bw) AS BIGINT) - ol) AS x0, least(width, CAST(trunc((c + 1) * bw) AS BIGINT) + orr) AS x1 FROM o)
SELECT doc_id, r * cols + c AS index, r AS row, c AS col, x0 AS x_offset, y0 AS y_offset, x1 - x0 AS w, y1 - y0 AS h, CAST(ot AS BIGINT) AS overlap_top, CAST(ob AS BIGINT) AS overlap_bottom, CAST(ol AS BIGINT) AS overlap_left, CAST(orr AS BIGINT) AS overlap_right FROM b"""

FACTOR = "CASE WHEN dpi >= 300 OR 300.0::DOUBLE / dpi < 1.1 THEN 1.0::DOUBLE ELSE least(300.0::DOUBLE / dpi, 3.0) END"
ANGLE = "((doc_id * 53) % 200 - 100) / 20.0::DOUBLE"


def plan(engine: str, color: bool, invert: bool, binarize: bool, scale: float) -> str:
    flat = "channels = 1" if color else "true"
    tests = [
        ("grayscale", "channels = 4" if color else "channels <> 1"), ("invert", f"{str(invert).lower()} AND doc_id % 7 = 0"), ("noise_removal", "((doc_id * 37) % 100) / 500.0::DOUBLE > 0.1::DOUBLE"),
        ("deskew", f"abs({ANGLE}) > 1.0"), ("normalization", f"((doc_id * 29) % 100) / 100.0::DOUBLE < 0.3::DOUBLE OR ({flat} AND ((doc_id * 17) % 100) / 100.0::DOUBLE < 0.8::DOUBLE)"),
        ("binarization", f"{str(binarize).lower()} AND NOT ({flat} AND doc_id % 11 = 0)"), ("scaling", f"{str(scale > 1).lower()} AND dpi < 300 AND 300.0::DOUBLE / dpi >= 1.1::DOUBLE"),
    ]
    names = lambda no: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {no} ({t}) THEN '{n}' END" for n, t in tests) + "], lambda x: x IS NOT NULL), ',')"
    return f"SELECT doc_id, '{engine}' AS engine, {names('')} AS applied, {names('NOT')} AS skipped, NOT abs({ANGLE}) < 1.0 AS rotates_page FROM dpi"


PLAN = f"WITH {META}, p AS ({plan('deepseek', False, True, True, 3.0)} UNION ALL {plan('qari', True, False, False, 1.0)})"

BAR, HALF = "=" * 21, "=" * 15
INFER = f"""WITH {PAGES}, t AS (SELECT job_id, page_number, CASE WHEN job_id % 3 = 0 THEN text ELSE '{BAR}' || chr(10) || 'BASE:  torch.Size([1])' || chr(10) || 'PATCHES:  torch.Size([2])' || chr(10) || '{BAR}' || chr(10) || text || chr(10) || 'PATCHES: x' || chr(10) || chr(10) || 'last line' || chr(10)
 || CASE WHEN job_id % 3 = 1 THEN '{HALF}save results:{HALF}' || chr(10) || 'ignored' ELSE '{BAR}' || chr(10) || 'more' END END AS s FROM page),
l AS (SELECT job_id, page_number, unnest(string_split(s, chr(10))) AS x, unnest(range(0, len(string_split(s, chr(10))))) AS i FROM t),
m AS (SELECT *, contains(x, '{BAR}') AND NOT contains(lower(x), 'save') AS mark FROM l),
k AS (SELECT *, NOT mark AND (contains(lower(x), 'save results') OR contains(x, '{HALF}')) AS stop, sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, page_number ORDER BY i) AS seen FROM m),
z AS (SELECT job_id, page_number, coalesce(min(i) FILTER (stop), 1000000000) AS last FROM k GROUP BY ALL)
SELECT z.job_id, z.page_number, coalesce({strip("string_agg(x, chr(10) ORDER BY i)")}, '') AS parsed FROM z LEFT JOIN k ON k.job_id = z.job_id AND k.page_number = z.page_number AND i < last AND NOT mark AND seen >= 2
 AND NOT starts_with({strip("x")}, 'BASE:') AND NOT starts_with({strip("x")}, 'PATCHES:') GROUP BY ALL"""

NEAREST = lambda g, ideal: f"list_filter({g}, lambda x: abs(x - {ideal}) = list_min(list_transform({g}, lambda z: abs(z - {ideal}))))[1]"
_STEP = lambda i: f"s{i} AS (SELECT doc_id, g, size, list_filter(l, lambda x: x <> pick) AS l, list_append(o, pick) AS o FROM (SELECT *, {NEAREST('l', f'(size * {i}.0::DOUBLE / 4.0::DOUBLE)')} AS pick FROM s{i - 1}))"
SELECT_GAPS = f"""WITH {GAPS}, s0 AS (SELECT doc_id, g, size, g AS l, []::BIGINT[] AS o FROM pos WHERE len(g) > 3), {_STEP(1)}, {_STEP(2)}, {_STEP(3)}
SELECT doc_id, array_to_string(list_sort(o), ',') AS splits FROM s3 UNION ALL SELECT doc_id, array_to_string(g, ',') FROM pos WHERE len(g) <= 3"""


def min_size(least: int) -> str:
    return f"""array_to_string(list_reduce(list_prepend({{'prev': 0::BIGINT, 'kept': []::BIGINT[]}}, list_transform(g, lambda x: {{'prev': x, 'kept': [x]}})), lambda a, x: CASE WHEN x.prev - a.prev >= {least} AND size - x.prev >= {least} THEN {{'prev': x.prev, 'kept': list_concat(a.kept, x.kept)}} ELSE a END).kept, ',')"""


COMPONENTS = f"""WITH {INK}, ln AS (SELECT doc_id, floor((y - 20) / 16.0) AS line, greatest(0, min(y) - 5) AS a, max(y) + 1 + 5 AS b FROM ink WHERE ink > 0 GROUP BY ALL),
sz AS (SELECT doc_id, count(*) AS size FROM ink GROUP BY doc_id),
fr AS (SELECT i.doc_id, i.y, sz.size FROM ink i JOIN sz USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.doc_id = i.doc_id AND i.y >= ln.a AND i.y < ln.b)),
one AS (SELECT doc_id, size, CAST(trunc(size / 3.0::DOUBLE * 1) AS BIGINT) AS i1, CAST(trunc(size / 3.0::DOUBLE * 2) AS BIGINT) AS i2 FROM sz JOIN (SELECT DISTINCT doc_id FROM ln) USING (doc_id)),
p AS (SELECT one.doc_id, one.size, i1, i2, arg_min(y, (abs(y - i1), y)) AS p1, arg_min(y, (abs(y - i2), y)) AS p2 FROM one LEFT JOIN fr USING (doc_id) GROUP BY ALL),
k AS (SELECT *, coalesce(abs(p1 - i1) < size / 3.0::DOUBLE * 0.5 AND p1 >= 64 AND p1 <= size - 64, false) AS ok1, coalesce(abs(p2 - i2) < size / 3.0::DOUBLE * 0.5 AND p2 >= 64 AND p2 <= size - 64, false) AS ok2 FROM p)
SELECT doc_id, array_to_string(list_sort(list_concat(CASE WHEN ok1 THEN [p1] ELSE [] END, CASE WHEN ok2 AND NOT (ok1 AND abs(p1 - p2) < 64) THEN [p2] ELSE [] END)), ',') AS splits FROM k"""

SMART = f"""WITH {GAPS}, ht AS (SELECT doc_id, count(*) AS height FROM ink GROUP BY doc_id),
pr AS (SELECT ht.doc_id, height, CASE WHEN g IS NULL THEN NULL WHEN len(g) = 1 THEN g[1] ELSE {NEAREST('g', '(height * 1.0::DOUBLE / 2.0::DOUBLE)')} END AS p FROM ht LEFT JOIN pos USING (doc_id)),
ok AS (SELECT *, coalesce(p >= 128 AND height - p >= 128, false) AS proj FROM pr),
ln AS (SELECT doc_id, floor((y - 20) / 16.0) AS line, greatest(0, min(y) - 5) AS a, max(y) + 1 + 5 AS b FROM ink WHERE ink > 0 GROUP BY ALL),
fr AS (SELECT i.doc_id, i.y FROM ink i WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.doc_id = i.doc_id AND i.y >= ln.a AND i.y < ln.b)),
q AS (SELECT ok.doc_id, height, proj, CAST(trunc(height / 2.0::DOUBLE) AS BIGINT) AS ideal, arg_min(y, (abs(y - CAST(trunc(height / 2.0::DOUBLE) AS BIGINT)), y)) AS c FROM ok LEFT JOIN fr USING (doc_id) GROUP BY ALL),
z AS (SELECT doc_id, proj, NOT proj AND coalesce(abs(c - ideal) < height / 2.0::DOUBLE * 0.5 AND c >= 64 AND c <= height - 64, false) AS comp, 1000 * height / 1000000.0::DOUBLE > 0.15::DOUBLE OR height > 2048 AS need FROM q)
SELECT doc_id, CASE WHEN NOT need THEN 'none' WHEN proj THEN 'projection' WHEN comp THEN 'components' ELSE 'grid' END AS method, CASE WHEN proj THEN 'projection' WHEN comp THEN 'components' ELSE 'grid' END AS recommended FROM z"""

LOCKS = f"""WITH {MODELS}, a AS (SELECT user_id, list(us ORDER BY us, event_id) AS u, list(event_id ORDER BY us, event_id) AS ids FROM m WHERE locks GROUP BY user_id),
s AS (SELECT user_id, list_reduce(list_transform(range(1, len(u) + 1), lambda i: {{'at': u[i], 'holder': ids[i], 'n': 1::BIGINT}}), lambda a, x: CASE WHEN x.at - a.at >= 900000000 THEN {{'at': x.at, 'holder': x.holder, 'n': a.n + 1}} ELSE a END) AS s FROM a)
SELECT user_id, s.n AS acquisitions, s.holder AS holder FROM s"""

NAME = "CASE WHEN job_id % 6 = 0 THEN 'a \"quoted\" \\ name.png' ELSE 'f' || job_id || '.png' END"

RASTER = """v AS (SELECT doc_id, list_transform(string_split(rpad(regexp_replace(text, '[^ -~]', '~', 'g'), CAST(64 * greatest(48, ceil(length(text) / 64.0::DOUBLE)) AS INT), ' '), ''), lambda c: CAST(unicode(c) AS BIGINT)) AS v FROM documents)"""

QUALITY = """WITH px AS (SELECT doc_id, (i - 1) // 64 AS y, (i - 1) % 64 AS x, t[i] AS c, unicode(t[i]) AS v, len(t) // 64 AS height FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM
 (SELECT doc_id, string_split(rpad(regexp_replace(text, '[^ -~]', '~', 'g'), CAST(64 * greatest(48, ceil(length(text) / 64.0::DOUBLE)) AS INT), ' '), '') AS t FROM documents))),
lap AS (SELECT doc_id, height, v, coalesce(lag(v) OVER r, lead(v) OVER r) + coalesce(lead(v) OVER r, lag(v) OVER r) + coalesce(lag(v) OVER c, lead(v) OVER c) + coalesce(lead(v) OVER c, lag(v) OVER c) - 4 * v AS l
 FROM px WINDOW r AS (PARTITION BY doc_id, y ORDER BY x), c AS (PARTITION BY doc_id, x ORDER BY y)),
s AS (SELECT doc_id, max(height) AS height, count(*) AS n, sum(l) AS s1, sum(l * l) AS s2, min(v) AS lo, max(v) AS hi, sum(v) AS t FROM lap GROUP BY doc_id),
h AS (SELECT doc_id, v, count(*) AS k FROM lap GROUP BY doc_id, v),
c AS (SELECT doc_id, v, CAST(sum(k) OVER w AS BIGINT) AS w0, CAST(sum(k * v) OVER w AS BIGINT) AS m0, CAST(sum(k) OVER a AS BIGINT) AS w, CAST(sum(k * v) OVER a AS BIGINT) AS m FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY v), a AS (PARTITION BY doc_id)),
o AS (SELECT doc_id, arg_min(v, (-b, v)) AS otsu FROM (SELECT doc_id, v, CASE WHEN w0 < w THEN (m0 * w - m * w0)::DOUBLE * (m0 * w - m * w0)::DOUBLE / (w0::DOUBLE * (w - w0)::DOUBLE) ELSE 0.0 END AS b FROM c) GROUP BY doc_id),
d AS (SELECT doc_id, sum(k) AS dark FROM h JOIN o USING (doc_id) WHERE v <= otsu GROUP BY doc_id)
SELECT doc_id, blur AS blur_score, round((hi - lo) / (hi + lo)::DOUBLE, 6) AS contrast, round(t / (n * 255.0::DOUBLE), 6) AS brightness, CAST(otsu AS BIGINT) AS otsu, round(dark / n::DOUBLE, 6) AS content_density,
 CAST(72 AS BIGINT) AS estimated_dpi, blur < 100.0 AS needs_sharpening
FROM (SELECT *, round((n * s2 - s1 * s1)::DOUBLE / (n * n)::DOUBLE, 6) AS blur FROM s JOIN o USING (doc_id) JOIN d USING (doc_id))"""

ORACLE_SQL = {
    "page_quality": QUALITY,
    "merge_exact_overlap": merged(1),
    "merge_two_columns": merged(2),
    "reading_order_ltr": formatted("c"),
    "reading_order_rtl": formatted("c DESC"),
    "adjacent_pairs": f"""WITH {chunks(2)} SELECT doc_id, idx AS index, lag(idx) OVER w AS previous, coalesce((r = lag(r) OVER w AND abs(c - lag(c) OVER w) = 1) OR (abs(r - lag(r) OVER w) = 1 AND c = lag(c) OVER w), false) AS is_adjacent FROM chunk WINDOW w AS (PARTITION BY doc_id ORDER BY r, c)""",
    "chunk_concat": f"WITH {chunks(1)} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM chunk GROUP BY doc_id",
    "section_merge": sections("p"),
    "section_merge_rtl": sections("p // 2, p DESC"),
    "pdf_page_merge": f"""WITH {PAGES} SELECT job_id, string_agg('=== Page ' || page_number || ' of ' || total_pages || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number) AS text,
 coalesce(string_agg('=== Page ' || page_number || ' of ' || total_pages || ' ===' || chr(10) || formatted_text, chr(10) || chr(10) ORDER BY page_number) FILTER (formatted_text <> ''), '') AS formatted_text,
 round(CAST(sum(conf) AS BIGINT) / 100.0::DOUBLE / max(total_pages), 6) AS confidence, max(total_pages) AS total_pages, string_agg(page_number || ':' || conf, ',' ORDER BY page_number) AS metadata FROM page GROUP BY job_id""",
    "infer_output_parse": INFER,
    "rtl_marks": f"""WITH {chunks(1)} SELECT doc_id, idx AS index, length(t) AS before, regexp_replace(t, '{char_class(MARKS)}', '', 'g') AS plain FROM (SELECT *, replace(text, 'a', 'a' || chr(1614)) AS t FROM chunk)""",
    "result_base64": "SELECT doc_id, to_base64(encode(text)) AS encoded FROM documents",
    "needs_splitting": f"""WITH {META} SELECT doc_id, engine, width * height / 1000000.0::DOUBLE > mp OR width > dim OR height > dim AS needs_split FROM (SELECT *, CASE WHEN engine = 'qari' THEN 2.5 ELSE 2.0 END::DOUBLE AS mp, CASE WHEN engine = 'qari' THEN 2560 ELSE 2048 END AS dim FROM (SELECT *, ['qari', 'got', 'deepseek', 'other'][CAST(doc_id % 4 AS INT) + 1] AS engine FROM meta))""",
    "estimated_dpi": f"WITH {META} SELECT doc_id, dpi FROM dpi",
    "target_chunks_grid": f"""WITH {META}, t AS (SELECT doc_id, CAST(greatest(ceil(width * height / 1000000.0::DOUBLE / 2.0::DOUBLE), ceil(width / 2048.0) * ceil(height / 2048.0), 2) AS BIGINT) AS target FROM meta) SELECT doc_id, target, CAST(ceil(sqrt(target)) AS BIGINT) AS rows, CAST(ceil(target / ceil(sqrt(target))) AS BIGINT) AS cols FROM t""",
    "grid_size": grids(1024, 2048, 2.0) + " SELECT doc_id, prefer_horizontal, rows, CAST(cols AS BIGINT) AS cols FROM grid",
    "grid_tiles": TILES,
    "boundary_tiles": f"""WITH {META}, y AS (SELECT doc_id, width, unnest([0, 1, 2]) AS row, unnest([0, height // 3, 2 * height // 3]) AS y0, unnest([height // 3, 2 * height // 3, height]) AS y1 FROM meta), x AS (SELECT *, unnest([0, 1]) AS col, unnest([0, width // 2]) AS x0, unnest([width // 2, width]) AS x1 FROM y)
 SELECT doc_id, CAST(row * 2 + col AS BIGINT) AS index, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, x0 AS x_offset, y0 AS y_offset, x1 - x0 AS w, y1 - y0 AS h FROM x""",
    "legacy_suggested_grid": SUGGESTED + " SELECT doc_id, rows, cols FROM grid",
    "legacy_grid_tiles": SUGGESTED + """, t AS (SELECT *, width // cols AS cw, height // rows AS ch FROM (SELECT *, unnest(range(0, cols)) AS c FROM (SELECT *, unnest(range(0, rows)) AS r FROM grid))), o AS (SELECT *, CAST(trunc(cw * 0.1::DOUBLE) AS BIGINT) AS ox, CAST(trunc(ch * 0.1::DOUBLE) AS BIGINT) AS oy FROM t)
 SELECT doc_id, r AS row, c AS col, greatest(0, c * cw - ox) AS x1, greatest(0, r * ch - oy) AS y1, least(width, (c + 1) * cw + ox) AS x2, least(height, (r + 1) * ch + oy) AS y2 FROM o""",
    "legacy_columns": f"WITH {META} SELECT doc_id, i, i * (width // 3) AS x1, CASE WHEN i = 2 THEN width ELSE (i + 1) * (width // 3) END AS x2, height AS y2 FROM (SELECT *, unnest(range(0, 3)) AS i FROM meta)",
    "scale_factor_dims": f"WITH {META} SELECT doc_id, round(f, 6) AS factor, CAST(trunc(width * f) AS BIGINT) AS w, CAST(trunc(height * f) AS BIGINT) AS h FROM (SELECT *, {FACTOR} AS f FROM dpi)",
    "adaptive_block_size": f"WITH {META} SELECT doc_id, CAST(b + CASE WHEN b % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS block FROM (SELECT doc_id, greatest(11, least(101, least(width, height) // 20)) AS b FROM meta)",
    "rotation_canvas": f"WITH {META} SELECT doc_id, a AS angle, CAST(trunc(height * s + width * c) AS BIGINT) AS w, CAST(trunc(height * c + width * s) AS BIGINT) AS h FROM (SELECT *, round(abs(cos(radians(a))), 9) AS c, round(abs(sin(radians(a))), 9) AS s FROM (SELECT *, {ANGLE} AS a FROM meta))",
    "step_plan": PLAN + " SELECT * FROM p",
    "applied_step_union": PLAN + ", u AS (SELECT DISTINCT doc_id % 50 AS grp, unnest(string_split(applied, ',')) AS s FROM p) SELECT grp, string_agg(s, ',' ORDER BY list_position(['grayscale', 'invert', 'noise_removal', 'deskew', 'normalization', 'binarization', 'scaling'], s)) AS steps FROM u WHERE s <> '' GROUP BY grp",
    "detect_file_type": f"WITH {UPLOADS} SELECT doc_id, kind AS file_type FROM kind",
    "validate_upload": f"WITH {UPLOADS} SELECT doc_id, {check('image', 50)} AS image_result, {check('pdf', 100)} AS pdf_result, dpi BETWEEN 72 AND 600 AS dpi_ok FROM kind",
    "validate_filename": f"""WITH {UPLOADS}, b AS (SELECT doc_id, filename, regexp_extract(regexp_replace(filename, '(/\\.?)+$', ''), '([^/]*)$', 1) AS base FROM up)
 SELECT doc_id, base, CASE WHEN filename = '' THEN 'Filename cannot be empty' WHEN base = '' OR base = '.' THEN 'Invalid filename' WHEN contains(base, '..') OR starts_with(base, '.') THEN 'Invalid filename pattern' WHEN length(base) > 255 THEN 'Filename too long (max 255 characters)' ELSE 'ok' END AS result FROM b""",
    "row_projection": f"WITH {INK} SELECT doc_id, count(*) AS n, CAST(sum(window_ink) AS BIGINT) AS total, max(top) AS top, max({VALUE}) AS peak, CAST(sum(CASE WHEN window_ink < 0.25 * top THEN 1 ELSE 0 END) AS BIGINT) AS low FROM smooth GROUP BY doc_id",
    "col_projection": f"WITH {INK} SELECT doc_id, y AS x, {VALUE} AS v FROM smooth",
    "find_gaps": f"WITH {GAPS} SELECT doc_id, center, size FROM gap",
    "select_gaps": SELECT_GAPS,
    "min_size_filter": f"WITH {GAPS} SELECT doc_id, {min_size(64)} AS min64, {min_size(256)} AS min256 FROM pos",
    "otsu_threshold": f"""WITH {INK}, h AS (SELECT doc_id, ink % 256 AS v, count(*) AS n FROM ink GROUP BY ALL), c AS (SELECT doc_id, v, CAST(sum(n) OVER w AS BIGINT) AS w0, CAST(sum(n * v) OVER w AS BIGINT) AS m0, CAST(sum(n) OVER a AS BIGINT) AS w, CAST(sum(n * v) OVER a AS BIGINT) AS m FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY v), a AS (PARTITION BY doc_id)),
 b AS (SELECT doc_id, v, CASE WHEN w0 < w THEN (m0 * w - m * w0)::DOUBLE * (m0 * w - m * w0)::DOUBLE / (w0::DOUBLE * (w - w0)::DOUBLE) ELSE 0.0 END AS b FROM c) SELECT doc_id, arg_min(v, (-b, v)) AS threshold FROM b GROUP BY doc_id""",
    "component_splits": COMPONENTS,
    "job_latest_state": f"WITH {JOBS} SELECT job_id, status, updated_us, error FROM latest",
    "job_expired": f"WITH {JOBS} SELECT job_id, now_us - updated_us > 3600000000 AS expired FROM latest",
    "stale_jobs": f"WITH {JOBS}, s AS (SELECT *, status = 'processing' AND now_us - updated_us > 300000000 AS is_stale FROM latest) SELECT job_id, CASE WHEN is_stale THEN 'failed' ELSE status END AS status, CASE WHEN is_stale THEN 'Job timed out - worker may have crashed' ELSE error END AS error, is_stale FROM s",
    "model_listing": f"""WITH {MODELS}, l AS (SELECT model, arg_max(status, (us, event_id)) AS raw, max(us) AS u, max(now_us) AS n, arg_max({{'p': progress}}, (us, event_id)).p AS p FROM m GROUP BY model), s AS (SELECT r.model, p, coalesce(CASE WHEN raw IN ('downloading', 'loading') AND n - u > 600000000 THEN 'not_found' ELSE raw END, 'not_found') AS status FROM (VALUES ('qari'), ('got'), ('deepseek')) r(model) LEFT JOIN l ON l.model = r.model)
 SELECT model, model = 'deepseek' AS is_loaded, status = 'ready' AS is_available, status, coalesce(p, 0.0) AS progress FROM s""",
    "stale_model_status": f"WITH {MODELS}, s AS (SELECT user_id, arg_max(status, (us, event_id)) AS status FROM m GROUP BY user_id) SELECT user_id, status FROM s WHERE status IN ('downloading', 'loading') AND user_id NOT IN (SELECT user_id FROM m WHERE locks AND now_us - us <= 900000000)",
    "available_models": "SELECT DISTINCT m AS model FROM (SELECT ['qari', 'got', 'deepseek', 'tmp', '.cache'][CAST(user_id % 5 AS INT) + 1] AS m FROM events) WHERE m IN ('qari', 'got', 'deepseek')",
    "resolve_engine": f"""WITH {MODELS}, s AS (SELECT model, arg_max(status, (us, event_id)) AS status FROM m GROUP BY model), u AS (SELECT DISTINCT user_id, coalesce(nullif(['qari', '', NULL, 'unknown'][CAST(user_id % 4 AS INT) + 1], ''), nullif(CASE WHEN user_id % 3 = 0 THEN 'got' ELSE '' END, ''), 'deepseek') AS engine FROM m)
 SELECT user_id, engine, CAST(CASE WHEN engine NOT IN ('qari', 'got', 'deepseek') THEN 400 WHEN status IN ('downloading', 'failed') THEN 503 ELSE 202 END AS BIGINT) AS code FROM u LEFT JOIN s ON s.model = u.engine""",
    "download_lock_winner": LOCKS,
    "job_timeout_budget": "SELECT conv_id AS job_id, count(*) * 1200 AS timeout_s FROM conversations GROUP BY conv_id",
    "webhook_payload": f"""WITH {JOBS} SELECT job_id, CAST(json_object('job_id', job_id::VARCHAR, 'status', status, 'filename', {NAME}, 'result', CASE WHEN status = 'completed' THEN {{'text': 'page' || chr(10) || job_id, 'confidence': CAST(job_id % 100 AS BIGINT)}} END, 'error', error) AS VARCHAR) AS payload FROM latest WHERE status IN ('completed', 'failed')""",
    "failure_handler": "SELECT event_id, user_id AS job_id, CASE WHEN event_id % 3 = 0 THEN 'process_pdf_job' ELSE 'process_ocr_job' END AS func, CASE WHEN event_id % 3 <> 0 THEN 'RuntimeError: E' || event_id END AS marked FROM events WHERE event_type = 'error'",
    "download_complete": "SELECT model, bytes, NOT open AND bytes >= 104857600 AS complete FROM (SELECT doc_id % 97 AS model, CAST(sum(n_chars * 7919) AS BIGINT) AS bytes, bool_or(doc_id % 331 = 5) AS open FROM documents GROUP BY 1)",
    "pixel_statistics": f"WITH {RASTER} SELECT doc_id, round((hi - lo) / (hi + lo)::DOUBLE, 6) AS contrast, round(t / (n * 255.0::DOUBLE), 6) AS brightness, round((255 * n - t) / n::DOUBLE, 6) AS inverted_mean, n_values FROM (SELECT doc_id, len(v) AS n, list_min(v) AS lo, list_max(v) AS hi, CAST(list_sum(v) AS BIGINT) AS t, CAST(len(list_distinct(v)) AS BIGINT) AS n_values FROM v)",
    "engine_pipeline": merged(1),
    "engine_concat": f"WITH {chunks(1)} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM chunk GROUP BY doc_id",
    "pdf_to_pages": "SELECT doc_id, n AS page_number, total AS total_pages, doc_id || '_page_' || printf('%03d', n) || '.png' AS page_name, CAST(strlen(l) AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS error FROM (SELECT doc_id, len(string_split(text, chr(10))) AS total, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)",
    "job_state_stream": f"WITH {JOBS} SELECT job_id, status, updated_us, error FROM latest",
    "image_info": SUGGESTED + " SELECT k.doc_id, k.width, k.height, round(k.width * k.height / 1000000.0::DOUBLE, 6) AS megapixels, need AS needs_splitting, rows, cols FROM k JOIN grid USING (doc_id)",
    "scale_to_dpi": f"WITH {META} SELECT doc_id, CAST(trunc(width * f) AS BIGINT) AS w, CAST(trunc(height * f) AS BIGINT) AS h, CAST(trunc(width * 1.5::DOUBLE) AS BIGINT) AS by_factor_w, CAST(trunc(height * 1.5::DOUBLE) AS BIGINT) AS by_factor_h FROM (SELECT *, CASE WHEN dpi >= 400 THEN 1.0::DOUBLE ELSE least(400.0::DOUBLE / dpi, 3.0) END AS f FROM dpi)",
    "split_grid": f"""WITH {META}, t AS (SELECT doc_id, CAST(greatest(ceil(width * height / 1000000.0::DOUBLE / 2.0::DOUBLE), ceil(width / 2048.0) * ceil(height / 2048.0), 2) AS BIGINT) AS target FROM meta), g AS (SELECT doc_id, CAST(ceil(sqrt(target)) AS BIGINT) AS a, CAST(ceil(target / ceil(sqrt(target))) AS BIGINT) AS b FROM t)
 SELECT doc_id, p AS prefer_horizontal, CASE WHEN p THEN a ELSE b END AS rows, CASE WHEN p THEN b ELSE a END AS cols FROM g, (VALUES (false), (true)) v(p)""",
    "current_model": f"WITH {MODELS}, l AS (SELECT arg_max({{'m': model, 's': status}}, (us, event_id)) AS x FROM m WHERE status IN ('ready', 'not_found')) SELECT coalesce(CASE WHEN x.s = 'ready' THEN x.m END, 'deepseek') AS model FROM l",
    "status_map": f"WITH {MODELS}, s AS (SELECT model, arg_max(status, (us, event_id)) AS raw, max(us) AS u, max(now_us) AS n FROM m GROUP BY model) SELECT string_agg(model || '=' || CASE WHEN raw IN ('downloading', 'loading') AND n - u > 600000000 THEN 'not_found' ELSE raw END, ',' ORDER BY model) AS statuses FROM s",
    "submit_upload": f"""WITH {MODELS}, {UPLOADS}, s AS (SELECT model, arg_max(status, (us, event_id)) AS status FROM m GROUP BY model), u AS (SELECT *, coalesce(nullif(['qari', '', 'nope'][CAST(doc_id % 3 AS INT) + 1], ''), 'deepseek') AS engine, regexp_extract(regexp_replace(filename, '(/\\.?)+$', ''), '([^/]*)$', 1) AS base FROM kind),
 c AS (SELECT doc_id, engine, base, CAST(CASE WHEN engine NOT IN ('qari', 'got', 'deepseek') THEN 400 WHEN status IN ('downloading', 'failed') THEN 503 WHEN filename = '' OR base = '' OR base = '.' OR contains(base, '..') OR starts_with(base, '.') OR length(base) > 255 OR {check('image', 50)} <> 'ok' THEN 400 ELSE 202 END AS BIGINT) AS code FROM u LEFT JOIN s ON s.model = u.engine)
 SELECT doc_id, engine, code, CASE WHEN code = 202 THEN 'pending' END AS state, CASE WHEN code = 202 THEN doc_id || CASE WHEN regexp_extract(base, '^.+(\\.[^.]+)$', 1) = '' THEN '.png' ELSE regexp_extract(base, '^.+(\\.[^.]+)$', 1) END END AS stored_as FROM c""",
    "job_lookup": f"WITH {JOBS} SELECT 'job:' || job_id AS key, status FROM latest WHERE job_id % 10 <> 3 AND starts_with('job:' || job_id, 'job:1')",
    "rtl_merge": merged(1, "CASE WHEN idx % 2 = 1 THEN replace(text, 'e', 'e' || chr(1616)) ELSE text END", rtl=True),
    "smart_split_method": SMART,
}
