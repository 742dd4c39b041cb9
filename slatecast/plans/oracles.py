"""SQL for DuckDB that gives the rows of the queries by other means."""

from __future__ import annotations

from slatecast.functions import text as rules
from slatecast.plans.views import DET, MK, PX


def det(body: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{DET}{''.join(', ' + x for x in more)} {body}"


def markers(body: str) -> str:
    return f"WITH {DET}, {MK} {body}"


def _smpte(frame: str, fps: str) -> str:
    t = f"({frame}::DOUBLE / {fps})"
    pad = lambda x: f"(CASE WHEN {x} < 10 THEN '0' ELSE '' END || {x})"
    return f"{pad(f'floor({t} / 3600)::BIGINT')} || ':' || {pad(f'floor(({t} % 3600) / 60)::BIGINT')} || ':' || {pad(f'floor({t} % 60)::BIGINT')} || ':' || {pad(f'round_even(({t} - floor({t})) * {fps}, 0)::BIGINT')}"


SMPTE = det(f"SELECT rid, {_smpte('frame_number', '25::DOUBLE')} AS tc25, {_smpte('frame_number', '29.97::DOUBLE')} AS tc2997, {_smpte('(frame_number * 1000)', '24::DOUBLE')} AS tc_long FROM det")

_PARTS = "string_split(" + _smpte("frame_number", "25::DOUBLE") + ", ':')"
TIME_TO_FRAME = det(
    """SELECT rid, n::INTEGER AS parts, floor(s * 25)::BIGINT + f AS frame, floor(s * 23.976::DOUBLE)::BIGINT + f AS frame_film FROM (
      SELECT rid, n, CASE n WHEN 1 THEN p[1]::BIGINT WHEN 2 THEN p[1]::BIGINT * 60 + p[2]::BIGINT ELSE p[1]::BIGINT * 3600 + p[2]::BIGINT * 60 + p[3]::BIGINT END AS s,
        CASE n WHEN 4 THEN p[4]::BIGINT ELSE 0 END AS f
      FROM coded CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n))""",
    f"coded AS (SELECT rid, {_PARTS} AS p FROM det)",
)


def _repaired(column: str, rule: rules.Repair) -> str:
    out = column
    for old, new in rule.replacements:
        out = f"replace({out}, '{old}', '{new}')"
    bare = f"WHEN t LIKE '{rule.bare}%' THEN '{rule.prefix}' || t[{rule.skip + 1}:]" if rule.bare else ""
    misread = ", ".join(f"'{w}'" for w in rule.misread)
    return f"""(SELECT CASE WHEN {column} = '' THEN '' WHEN starts_with(t, '{rule.prefix}') THEN t {bare}
      WHEN replace(lower(t[1:{rule.head}]), ' ', '') IN ({misread}) THEN '{rule.prefix}' || CASE WHEN contains(t, ':') THEN t[instr(t, ':') + 1:] WHEN contains(t, ';') THEN t[instr(t, ';') + 1:] ELSE t[{rule.head + 1}:] END
      ELSE '{rule.prefix}' || t END FROM (SELECT {out} AS t))"""


def normalize(kind: str | None, legacy: bool = False) -> str:
    vfx, di = (rules.LEGACY_VFX, rules.LEGACY_DI) if legacy else (rules.VFX, rules.DI)
    made = _repaired("text", vfx) if kind == "VFX" else _repaired("text", di) if kind == "DI" else f"CASE WHEN text_type = 'VFX' THEN {_repaired('text', vfx)} ELSE {_repaired('text', di)} END"
    return det(f"SELECT rid, {made} AS text FROM det")


KEPT = f"kept AS (SELECT * REPLACE (CASE WHEN text_type = 'VFX' THEN {_repaired('text', rules.VFX)} ELSE {_repaired('text', rules.DI)} END AS text) FROM det WHERE NOT confidence < 0.1)"
_ROW = "rid, frame_number, text_type, text, pixel_count, confidence"
FILTER = det(f"SELECT {_ROW} FROM kept WHERE trim(text) <> ''", KEPT)


def _alike(a: str, b: str) -> str:
    x, y = (f"list_distinct(string_split(lower({t}), ''))" for t in (a, b))
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END)"


def _iou(a: str, b: str) -> str:
    wide = f"(least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    high = f"(least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    shared = f"({wide} * {high})::DOUBLE"
    joint = f"(({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - {shared})"
    return f"(CASE WHEN {wide} <= 0 OR {high} <= 0 OR {joint} <= 0 THEN 0.0::DOUBLE ELSE {shared} / {joint} END)"


_BY_FRAME = "OVER (PARTITION BY video_id ORDER BY frame_number, rid)"
SIMILARITY = det(f"SELECT rid, {_alike('before', 'text')} AS similarity FROM (SELECT rid, text, lag(text) {_BY_FRAME} AS before FROM det) WHERE before IS NOT NULL")
IOU = det(f"SELECT a.rid, {_iou('b.', 'a.')} AS iou FROM n a JOIN n b ON a.video_id = b.video_id AND a.pos = b.pos + 1", f"n AS (SELECT *, row_number() {_BY_FRAME} AS pos FROM det)")
PIXEL_THRESHOLD = det("SELECT rid, text_type, pixel_count FROM det WHERE pixel_count >= 681")
EVERY_OTHER = det("SELECT rid, text_type FROM (SELECT rid, text_type, row_number() OVER (PARTITION BY video_id, text_type ORDER BY frame_number, rid) AS n FROM det WHERE pixel_count > 680) WHERE n % 2 = 1")
ONE_COLOUR = det(
    """SELECT rid, frame_number, 'VFX' AS text_type FROM v WHERE vfx AND n % 2 = 1 UNION ALL
    SELECT rid, frame_number, 'DI' FROM (SELECT rid, frame_number, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) AS n FROM v WHERE di AND NOT (vfx AND n % 2 = 1)) WHERE n % 2 = 1""",
    "f AS (SELECT video_id, rid, frame_number, text_type = 'VFX' OR rid % 3 = 0 AS vfx, text_type = 'DI' OR rid % 3 = 0 AS di FROM det WHERE pixel_count > 680)",
    "v AS (SELECT *, sum(vfx::INTEGER) OVER (PARTITION BY video_id ORDER BY frame_number) AS n FROM f)",
)
MOVING_MEAN = det("SELECT rid, round(avg(pixel_count) OVER (PARTITION BY video_id, text_type ORDER BY frame_number, rid ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean_pixels FROM det WHERE pixel_count > 680")
LEGACY_TRIGGER = det(
    "SELECT rid, frame_number, text_type, pixel_count FROM walk WHERE due",
    "h AS (SELECT *, row_number() OVER (PARTITION BY video_id, text_type ORDER BY frame_number) AS n FROM det WHERE pixel_count > 680)",
    """walk AS (SELECT video_id, text_type, 0::BIGINT AS n, NULL::BIGINT AS rid, NULL::BIGINT AS frame_number, NULL::BIGINT AS pixel_count, false AS due, 0::BIGINT AS last_frame, 0::BIGINT AS last_count FROM h WHERE n = 1
      UNION ALL SELECT video_id, text_type, n, rid, frame_number, pixel_count, due, CASE WHEN due AND k % 5 <> 0 THEN frame_number ELSE last_frame END, CASE WHEN due AND k % 5 <> 0 THEN pixel_count ELSE last_count END
      FROM (SELECT h.*, h.n >= 5 AND h.frame_number - last_frame >= 25 AND (h.frame_number - last_frame >= 250 OR abs(h.pixel_count - last_count) > 0.3::DOUBLE * last_count) AS due, last_frame, last_count
        FROM walk JOIN h ON h.video_id = walk.video_id AND h.text_type = walk.text_type AND h.n = walk.n + 1))""",
    recursive=True,
)
GAP_SESSIONS = det(
    f"""SELECT {_ROW}, group_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id, group_id ORDER BY confidence DESC, pixel_count DESC, rid) AS place
      FROM (SELECT *, sum(cut) {_BY_FRAME}::BIGINT AS group_id FROM c)) WHERE place = 1""",
    f"c AS (SELECT *, CASE WHEN frame_number - lag(frame_number) {_BY_FRAME} <= 2 AND text_type = lag(text_type) {_BY_FRAME} THEN 0 ELSE 1 END AS cut FROM det)",
)
_FOLD = (
    KEPT,
    f"c AS (SELECT *, CASE WHEN frame_number - lag(frame_number) {_BY_FRAME} <= 12 AND text_type = lag(text_type) {_BY_FRAME} THEN 0 ELSE 1 END AS cut, lag(text) {_BY_FRAME} AS before FROM kept)",
    "s AS (SELECT *, sum(cut) OVER (ORDER BY video_id, frame_number, rid) AS seg FROM c)",
    f"p AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY frame_number, rid) AS pos, CASE WHEN before IS NULL THEN 0 ELSE {_alike('before', 'text')} END AS kin FROM s)",
    f"""walk AS (
      SELECT seg, pos, rid, rid AS group_id, x1, y1, x2, y2 FROM p WHERE pos = 1
      UNION ALL
      SELECT n.seg, n.pos, n.rid, CASE WHEN fresh THEN n.rid ELSE group_id END, CASE WHEN fresh THEN n.x1 ELSE ax1 END, CASE WHEN fresh THEN n.y1 ELSE ay1 END, CASE WHEN fresh THEN n.x2 ELSE ax2 END, CASE WHEN fresh THEN n.y2 ELSE ay2 END
      FROM (SELECT n.*, w.group_id, w.x1 AS ax1, w.y1 AS ay1, w.x2 AS ax2, w.y2 AS ay2, n.kin < 0.8 AND {_iou('w.', 'n.')} < 0.8 AS fresh FROM walk w JOIN p n ON n.seg = w.seg AND n.pos = w.pos + 1) n)""",
)
GROUPS = det("SELECT rid, group_id FROM walk", *_FOLD, recursive=True)


def _sessions(least: int = 10) -> tuple[str, ...]:
    return (
        "g AS (SELECT kept.*, group_id, count(*) OVER w AS n, max(confidence) OVER w AS top, min(frame_number) OVER w AS start FROM kept JOIN walk USING (rid) WINDOW w AS (PARTITION BY group_id))",
        f"ses AS (SELECT * REPLACE (start AS frame_number) FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY length(trim(text)) DESC, frame_number, rid) AS place FROM g WHERE n >= {least} AND abs(confidence - top) < 0.01) WHERE place = 1)",
    )


SESSIONS = det(f"SELECT {_ROW}, group_id FROM ses", *_FOLD, *_sessions(), recursive=True)


def _merge(table: str, order: str) -> tuple[str, ...]:
    return (
        f"mc AS (SELECT *, {order} AS seq, CASE WHEN frame_number - lag(frame_number) OVER (ORDER BY frame_number, {order}) <= 25 THEN 0 ELSE 1 END AS far FROM {table})",
        "ms AS (SELECT *, sum(far) OVER (ORDER BY frame_number, seq) AS mseg FROM mc)",
        "mp AS (SELECT *, row_number() OVER (PARTITION BY mseg ORDER BY seq) AS mpos FROM ms)",
        f"""lead AS (
          SELECT mseg, mpos, rid, seq AS leader, [{{'k': text_type, 'f': frame_number, 't': text, 'q': seq}}] AS held FROM mp WHERE mpos = 1
          UNION ALL
          SELECT mseg, mpos, rid, coalesce(hit, seq), CASE WHEN hit IS NULL THEN list_append(held, {{'k': text_type, 'f': frame_number, 't': text, 'q': seq}}) ELSE held END
          FROM (SELECT n.*, w.held, list_filter(w.held, lambda l: l.k = n.text_type AND abs(l.f - n.frame_number) <= 25 AND {_alike('l.t', 'n.text')} > 0.8)[1].q AS hit
            FROM lead w JOIN mp n ON n.mseg = w.mseg AND n.mpos = w.mpos + 1))""",
        f"mb AS (SELECT {table}.*, leader, row_number() OVER (PARTITION BY leader ORDER BY confidence DESC, pixel_count DESC, rid) AS mplace FROM {table} JOIN (SELECT rid, leader FROM lead) USING (rid))",
    )


MERGED = det(f"SELECT {_ROW}, leader FROM mb WHERE mplace = 1", KEPT, *_merge("kept", "rid"), recursive=True)
FULL = det(f"SELECT {_ROW}, {_smpte('frame_number', '25::DOUBLE')} AS timecode, leader FROM mb WHERE mplace = 1", *_FOLD, *_sessions(), *_merge("ses", "group_id"), recursive=True)
BEST_BAND = det(
    f"""SELECT block, {_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY length(trim(text)) DESC, frame_number, rid) AS place
    FROM (SELECT *, rid // 16 AS block, max(confidence) OVER (PARTITION BY rid // 16) AS top FROM det) WHERE abs(confidence - top) < 0.05) WHERE place = 1"""
)
BEST_EXACT = det(f"SELECT block, {_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY confidence DESC, pixel_count DESC, rid) AS place FROM (SELECT * REPLACE (round(confidence, 1) AS confidence), rid // 16 AS block FROM det)) WHERE place = 1")
STATS = det("SELECT count(*) AS total_results, count(*) FILTER (text_type = 'VFX') AS vfx_count, count(*) FILTER (text_type = 'DI') AS di_count, round(coalesce(avg(confidence), 0), 9) AS avg_confidence, coalesce(min(frame_number) || ' - ' || max(frame_number), 'N/A') AS frame_range FROM det")
_IMPORT = """imp AS (SELECT rid, CASE rid % 7 WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE frame_number + 0.5::DOUBLE END AS frame_id,
  CASE rid % 11 WHEN 0 THEN 'MISC' WHEN 1 THEN '' ELSE text_type END AS kind, text AS note FROM det)"""
IMPORT = det("SELECT frame_id, CASE kind WHEN 'VFX' THEN 'Green' WHEN 'DI' THEN 'Yellow' ELSE 'Blue' END AS color, kind AS name, note, 1.0::DOUBLE AS duration, '' AS custom_data FROM imp WHERE frame_id IS NOT NULL", _IMPORT)
IMPORT_STATS = det("SELECT count(frame_id) AS success, count(*) - count(frame_id) AS failed, count(*) AS total FROM imp", _IMPORT)
DETECTIONS_CSV = det(f"""SELECT frame_number, {_smpte('frame_number', '25::DOUBLE')} AS timecode, text, pixel_count, (printf('%.3f', confidence))::DOUBLE AS confidence, text_type,
  (row_number() OVER (ORDER BY rid))::BIGINT AS line FROM det""")
MARKER_CSV = det("SELECT frame_number::DOUBLE AS frame_id, CASE text_type WHEN 'VFX' THEN 'Green' ELSE 'Yellow' END AS color, text_type AS name, text AS note, true AS ok FROM det")
MARKER_STORE = markers("""SELECT timeline_id, frame_id, CASE WHEN custom_data IN ('c3', 'c4') THEN '' ELSE color END AS color, name, CASE WHEN color = 'Blue' THEN '' ELSE note END AS note, duration,
  CASE WHEN color = 'Blue' THEN 'again' ELSE custom_data END AS custom_data FROM mk""")
_EVEN = "even AS (SELECT * FROM mk WHERE frame_id % 2 = 0 UNION ALL SELECT * REPLACE (frame_id + 0.5 AS frame_id, 'Orange' AS color) FROM mk WHERE frame_id % 4 = 2)"
MARKER_TABLE = f"""WITH {DET}, {MK}, {_EVEN}
  SELECT 'odd' AS timeline_id, frame_id, color, name, note, custom_data FROM mk WHERE frame_id % 2 = 1 AND NOT frame_id BETWEEN 100 AND 2000 AND color <> 'Blue' AND frame_id <> 1
  UNION ALL SELECT 'even', frame_id, color, name, note, custom_data FROM even WHERE frame_id <> (SELECT coalesce(min(frame_id), -1) FROM even WHERE custom_data = 'c42')"""
BASE_NAMES = det("""SELECT rid, video_id || '_' || rid || CASE WHEN rid % 3 = 0 THEN '.tar' ELSE '' END AS base, printf('%.2f', pixel_count / 1600::DOUBLE * 100) AS done FROM det""")

_HLS = """
unit AS (SELECT *, b / 255::DOUBLE AS ub, g / 255::DOUBLE AS ug, r / 255::DOUBLE AS ur FROM px),
span AS (SELECT *, greatest(ub, ug, ur) AS top, least(ub, ug, ur) AS low FROM unit),
raw AS (SELECT *, (top + low) / 2 AS rl,
  CASE WHEN top = low THEN 0 WHEN (top + low) / 2 < 0.5 THEN (top - low) / (top + low) ELSE (top - low) / (2 - top - low) END AS rs,
  CASE WHEN top = low THEN 0 WHEN top = ur THEN 60 * (ug - ub) / (top - low) WHEN top = ug THEN 120 + 60 * (ub - ur) / (top - low) ELSE 240 + 60 * (ur - ug) / (top - low) END AS rh FROM span),
hls AS (SELECT video_id, frame_number, y, x, b, g, r, round_even(CASE WHEN rh < 0 THEN rh + 360 ELSE rh END / 2, 0)::INTEGER AS h, round_even(rl * 255, 0)::INTEGER AS l, round_even(rs * 255, 0)::INTEGER AS s FROM raw),
flags AS (SELECT *, (h BETWEEN 45 AND 75 AND l BETWEEN 106 AND 195 AND s BETWEEN 138 AND 255)::INTEGER AS green, (h BETWEEN 10 AND 25 AND l BETWEEN 106 AND 160 AND s BETWEEN 75 AND 245)::INTEGER AS orange FROM hls)"""


def px(body: str) -> str:
    return f"WITH {PX}, {_HLS} {body}"


def _opened(table: str, flag: str, name: str) -> str:
    """Erosion and dilation by joining each pixel with those around it."""
    near = "a.frame_number = b.frame_number AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1"
    return f"""{name}_e AS (SELECT a.frame_number, a.y, a.x, min(({flag})::INTEGER) AS m FROM {table} a JOIN {table} b ON {near} GROUP BY ALL),
    {name} AS (SELECT frame_number, sum(m)::BIGINT AS n FROM (SELECT a.frame_number, a.y, a.x, max(b.m) AS m FROM {name}_e a JOIN {name}_e b ON {near} GROUP BY ALL) GROUP BY frame_number)"""


def morph(flag: str, name: str) -> str:
    return f"WITH {PX}, {_opened('px', 'b.' + flag, 'o')} SELECT frame_number, n AS {name} FROM o"


COLOURED = f"WITH {PX}, {_HLS}, {_opened('flags', 'b.green', 'og')}, {_opened('flags', 'b.orange', 'oo')} SELECT frame_number, og.n AS vfx_pixels, oo.n AS di_pixels FROM og JOIN oo USING (frame_number)"


#: Frames of cells of 4 by 4 pixels, which an opening leaves as they are: a hit is a frame of two cells of one colour.
_GRID_HITS = "counted AS (SELECT frame_number, 16 * sum(green)::BIGINT AS green, 16 * sum(orange)::BIGINT AS orange FROM flags GROUP BY frame_number)"
_HEX = "printf('%02X%02X%02X', b, g, r)"
_CORNERS = f"corners AS (SELECT frame_number, max({_HEX}) FILTER (y = 0 AND x = 0) AS first_pixel, max({_HEX}) FILTER (y = 7 AND x = 7) AS last_pixel FROM px GROUP BY frame_number)"
FRAME_IDS = "SELECT range AS frame_number FROM range(100, (SELECT count(*) FROM embeddings))"
FRAME_SOURCE = f"WITH {PX}, {_CORNERS} SELECT 'grids' AS video_id, frame_number, 32 AS height, 32 AS width, 3072 AS n_bytes, first_pixel, last_pixel FROM corners WHERE frame_number BETWEEN 130 AND 420"
FRAMES_WANTED = f"WITH {PX}, {_CORNERS} SELECT event_id AS rid, frame_number, first_pixel, last_pixel FROM events JOIN corners ON frame_number = event_id * 7 % 600"
_GRID_DET = (
    PX,
    _HLS,
    _GRID_HITS,
    "v AS (SELECT *, sum((green > 31)::INTEGER) OVER (ORDER BY frame_number) AS nv FROM counted)",
    "w AS (SELECT *, green > 31 AND nv % 2 = 1 AS by_green, sum((orange > 31 AND NOT (green > 31 AND nv % 2 = 1))::INTEGER) OVER (ORDER BY frame_number) AS nd FROM v)",
    """det AS (SELECT 'grids' AS video_id, 2 * frame_number + (NOT by_green)::BIGINT AS rid, frame_number, CASE WHEN by_green THEN 'VFX' ELSE 'DI' END AS text_type,
      CASE WHEN by_green THEN green ELSE orange END AS pixel_count, 0.85::DOUBLE AS confidence, '模拟OCR结果_' || frame_number AS text, 0 AS x1, 0 AS y1, 0 AS x2, 0 AS y2
      FROM w WHERE by_green OR (orange > 31 AND nd % 2 = 1))""",
)
VIDEO_PIPELINE = f"WITH RECURSIVE {', '.join((*_GRID_DET, *_FOLD, *_sessions(2), *_merge('ses', 'group_id')))} SELECT {_ROW}, {_smpte('frame_number', '25::DOUBLE')} AS timecode, leader FROM mb WHERE mplace = 1"
_GRID_TRIGGER = (
    PX,
    _HLS,
    _GRID_HITS,
    "hits AS (SELECT frame_number, 'VFX' AS text_type, green AS pixel_count FROM counted WHERE green > 31 UNION ALL SELECT frame_number, 'DI', orange FROM counted WHERE orange > 31)",
    "h AS (SELECT *, row_number() OVER (PARTITION BY text_type ORDER BY frame_number) AS n FROM hits)",
    """walk AS (SELECT text_type, 0::BIGINT AS n, 0::BIGINT AS frame_number, 0::BIGINT AS pixel_count, false AS due, 0::BIGINT AS last_frame, 0::BIGINT AS last_count FROM h WHERE n = 1
      UNION ALL SELECT text_type, n, frame_number, pixel_count, due, CASE WHEN due THEN frame_number ELSE last_frame END, CASE WHEN due THEN pixel_count ELSE last_count END
      FROM (SELECT h.*, h.n >= 5 AND h.frame_number - last_frame >= 25 AND (h.frame_number - last_frame >= 250 OR abs(h.pixel_count - last_count) > 0.3::DOUBLE * last_count) AS due, last_frame, last_count
        FROM walk JOIN h ON h.text_type = walk.text_type AND h.n = walk.n + 1))""",
)
VIDEO_PIPELINE_LEGACY = f"""WITH RECURSIVE {', '.join(_GRID_TRIGGER)} SELECT frame_number, {_smpte('frame_number', '25::DOUBLE')} AS timecode, {_repaired("('模拟OCR结果_' || frame_number)", rules.LEGACY_VFX)} AS vfx_text,
  {_repaired("('模拟OCR结果_' || frame_number)", rules.LEGACY_DI)} AS di_text, pixel_count, 0.85::DOUBLE AS confidence, text_type FROM walk WHERE due"""
VIDEO_PIPELINE_LEGACY = f"SELECT frame_number, timecode, CASE WHEN text_type = 'VFX' THEN vfx_text ELSE di_text END AS text, pixel_count, confidence, text_type FROM ({VIDEO_PIPELINE_LEGACY})"


def _lut() -> str:
    u = {c: f"({c} / 255::DOUBLE * 2)" for c in "rgb"}
    low = {c: f"least(floor({u[c]})::INTEGER, 1)" for c in "rgb"}
    at = ", ".join(f"{low[c]} AS {c}0, {u[c]} - {low[c]} AS {c}f" for c in "rgb")
    point = {
        "r": lambda r, g, b: f"(0.75 * ({r} / 2.0::DOUBLE) * ({r} / 2.0::DOUBLE) + 0.25 * ({g} / 2.0::DOUBLE))",
        "g": lambda r, g, b: f"(0.5 * ({g} / 2.0::DOUBLE) + 0.5 * ({g} / 2.0::DOUBLE) * ({g} / 2.0::DOUBLE))",
        "b": lambda r, g, b: f"(0.875 * ({b} / 2.0::DOUBLE) + 0.125 * ({r} / 2.0::DOUBLE))",
    }
    run = lambda a, b, f: f"({a} * (1 - {f}) + {b} * {f})"
    out = {}
    for c, p in point.items():
        r = {(g, b): run(p("r0", f"(g0 + {g})", f"(b0 + {b})"), p("(r0 + 1)", f"(g0 + {g})", f"(b0 + {b})"), "rf") for g in (0, 1) for b in (0, 1)}
        both = run(run(r[0, 0], r[1, 0], "gf"), run(r[0, 1], r[1, 1], "gf"), "bf")
        out[c] = f"floor(greatest(least({both}, 1.0::DOUBLE), 0.0::DOUBLE) * 255)::INTEGER AS {c}"
    return f"WITH {PX} SELECT frame_number, y, x, {', '.join(out.values())} FROM (SELECT frame_number, y, x, {at} FROM px)"


LUT = _lut()


def _lut_one() -> str:
    """Values over 0, 1/4 .. 1: a square for red, a half for green, as they are for blue."""
    point = {"r": lambda v: f"(({v}) / 4.0::DOUBLE * (({v}) / 4.0::DOUBLE))", "g": lambda v: f"(({v}) / 4.0::DOUBLE * 0.5)", "b": lambda v: f"(({v}) / 4.0::DOUBLE)"}
    u = {c: f"({c} / 255::DOUBLE * 4)" for c in "rgb"}
    at = ", ".join(f"least(floor({u[c]})::INTEGER, 3) AS {c}0, {u[c]} - least(floor({u[c]})::INTEGER, 3) AS {c}f" for c in "rgb")
    out = ", ".join(f"floor(greatest(least({p(c + '0')} * (1 - {c}f) + {p(c + '0 + 1')} * {c}f, 1.0::DOUBLE), 0.0::DOUBLE) * 255)::INTEGER AS {c}" for c, p in point.items())
    return f"WITH {PX} SELECT frame_number, y, x, {out} FROM (SELECT frame_number, y, x, {at} FROM px)"


LUT_ONE = _lut_one()
FRAGMENTS = det(
    """SELECT rid, first || second AS text, round((CASE WHEN k % 9 = 0 THEN 0 ELSE confidence END + CASE WHEN k % 4 = 0 THEN 0 ELSE 0.5 END) / n, 9) AS confidence, n::INTEGER AS n
    FROM (SELECT *, CASE WHEN k % 9 = 0 THEN '' ELSE text END AS first, CASE WHEN k % 4 >= 2 THEN 'tail' ELSE '' END AS second, (k % 9 <> 0)::INTEGER + (k % 4 <> 0)::INTEGER AS n FROM det) WHERE n > 0"""
)
POLYGONS = det("SELECT rid, x1, y1, x2, y2 FROM det UNION ALL SELECT rid, 1, 2, 9, 4 FROM det")
LARGEST = det("SELECT rid, CASE WHEN k % 9 = 0 THEN 1 ELSE x1 END AS x1, CASE WHEN k % 9 = 0 THEN 2 ELSE y1 END AS y1, CASE WHEN k % 9 = 0 THEN 9 ELSE x2 END AS x2, CASE WHEN k % 9 = 0 THEN 4 ELSE y2 END AS y2 FROM det WHERE k % 9 <> 0 OR k % 4 <> 0")
MOCK = det("SELECT rid, frame_number, '模拟OCR结果_' || frame_number AS text, 0.85::DOUBLE AS confidence, 0 AS x1, 0 AS y2 FROM det")
