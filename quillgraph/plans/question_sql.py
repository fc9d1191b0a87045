"""DuckDB SQL for the question types: draws by md5, rankings by sort, picks as folds over lists."""

from __future__ import annotations

from ..operators.questions import SAY
from .sql import DISPLAY, GRAPHS, HINT, SCORE, TOP, WORDS, _domains, _quoted, _safe, _signature

SEED = 42
TRIES = 8
COLUMNS = "image_id, paper_id, level, question_type, question, options, answer, answer_text, correct_option_indices, answer_type, metadata"


def _key(*parts: str) -> str:
    """md5 of the seed and of parts, given as SQL."""
    return "md5(" + " || '|' || ".join([f"'{SEED}'", *parts]) + ")"


def _number(key: str) -> str:
    return f"('0x' || substr({key}, 1, 8))::BIGINT"


def _signed(name: str, source: str) -> str:
    """name: source, which has texts as `shown`, with their signatures, domains (own), first and last word."""
    s = ", ".join(f"{v} {k}" for k, v in _signature("shown").items())
    words = "regexp_extract_all(lower(shown), '[a-z0-9]+')"
    return f", {name}0 AS (SELECT *, {s}, coalesce({words}[1], '') f, coalesce({words}[-1], '') l FROM {source}), {name} AS MATERIALIZED (SELECT *, {_domains('keywords')} own FROM {name}0)"


def _diverse(found: str, k: str) -> str:
    """The fold over a ranking of {t, f, l} that picks k texts."""
    ok = f"len(acc.o) < {k} AND (len(acc.o) < greatest(1, ({k}) // 2) OR NOT (list_contains(acc.e, c.l) AND list_contains(acc.s, c.f)))"
    more = "{'o': list_append(acc.o, c.t), 'e': list_append(acc.e, c.l), 's': list_append(acc.s, c.f)}"
    zero = "{'o': []::VARCHAR[], 'e': []::VARCHAR[], 's': []::VARCHAR[]}"
    return f"list_reduce(coalesce({found}, []::STRUCT(t VARCHAR, f VARCHAR, l VARCHAR)[]), lambda acc, c: CASE WHEN {ok} THEN {more} ELSE acc END, {zero}).o"


NEAR = " AND abs(c.token_count - t.token_count) <= 3 AND abs(c.char_length - t.char_length) <= greatest(12, t.char_length)"


def _ranked(name: str, rows: str, pool: str, where: str, same_graph: bool) -> str:
    """name: image_id, attempt, found (best first) for the target `shown` of each of rows."""
    join = f"JOIN {pool} c ON c.image_id = t.image_id" if same_graph else f"CROSS JOIN {pool} c"
    head = _signed(f"{name}_t", rows)
    return head + f""", {name} AS MATERIALIZED (SELECT t.image_id, t.attempt, list({{'t': c.shown, 'f': c.f, 'l': c.l}} ORDER BY {SCORE} DESC, c.shown) found
      FROM {name}_t t {join} JOIN hint h ON h.image_id = t.image_id WHERE {where} GROUP BY t.image_id, t.attempt)"""


BASE = (
    GRAPHS
    + WORDS
    + HINT
    + DISPLAY
    + """, disp AS MATERIALIZED (SELECT image_id, ord, id, CASE WHEN alone THEN shown ELSE phrase END AS text, told_ok told, CASE WHEN told_ok THEN refs ELSE [] END refs FROM shown_map WHERE alone OR told_ok),
tx AS MATERIALIZED (SELECT image_id, lower(text) key, min(text) shown FROM disp GROUP BY 1, 2), us AS (SELECT image_id, count(*) usable FROM tx GROUP BY 1),
kk AS MATERIALIZED (SELECT image_id, list(DISTINCT norm_text) ks FROM ent GROUP BY 1),
np AS (SELECT norm_text key, arg_min(shown, (image_id, ord)) shown FROM ent WHERE norm_text <> '' GROUP BY 1),
lp AS (SELECT lower(edge_text) key, arg_min(edge_text, (image_id, ord)) shown FROM rel WHERE edge_text <> '' GROUP BY 1),
txs AS (SELECT * FROM tx WHERE """
    + _safe("shown")
    + "), nps AS (SELECT * FROM np WHERE "
    + _safe("shown")
    + "), lps AS (SELECT * FROM lp WHERE "
    + _safe("shown")
    + ")"
    + _signed("own_texts", "txs")
    + _signed("nodes", "nps")
    + _signed("labels", "lps")
    + ", named AS (SELECT * FROM rel WHERE edge_text <> '' AND NOT is_conflict)"
)


def _drawn(name: str, source: str, q: str, parts: list[str]) -> str:
    order = _key(f"'{q}'", "image_id", *parts)
    return f", {name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}, {', '.join(parts)}) - 1 place, count(*) OVER (PARTITION BY image_id) candidates FROM {source})"


def _at(name: str, source: str, first: bool, done: str, again: bool = False, where: str = "true") -> str:
    """Drawn candidates at their first try, or at the others in graphs that are not in done."""
    tries = "attempt = 0" if first else f"attempt > 0 AND image_id NOT IN (SELECT image_id FROM {done})"
    once = "" if again else " AND attempt < candidates"
    return f", {name} AS (SELECT d.*, attempt FROM {source} d, range({TRIES}) r(attempt) WHERE attempt % candidates = place AND {tries}{once} AND {where})"


def _made(name: str, source: str, q: str, level: str, says: list[str], multi: str = "false") -> str:
    """name: whole questions of source (image_id, attempt, correct, wrong, a, b, c, metadata), by the try."""
    said = says[0] if len(says) == 1 else None
    phrases = lambda key: "[" + ", ".join(map(_quoted, SAY[key])) + "]"
    pick = lambda key: f"{phrases(key)}[({_number(_key(repr(q), 'image_id', 'attempt', repr('phrase')))} % {len(SAY[key])} + 1)::INT]"
    say = pick(said) if said else f"CASE WHEN c IS NULL THEN {pick(says[0])} ELSE {pick(says[1])} END"
    option = _key(f"'{q}'", "image_id", "'option'", "x")
    return f""", {name}_o AS (SELECT *, list_sort(list_transform(list_concat(correct, wrong), lambda x: {{'k': {option}, 't': x}})) o, {multi} multi FROM {source}),
    {name}_v AS (SELECT *, list_filter(range(len(o)), lambda i: list_contains(correct, o[i + 1].t)) at_ FROM {name}_o
      WHERE len(list_distinct(list_transform(o, lambda x: lower(x.t)))) = len(o) AND CASE WHEN multi THEN len(o) >= 4 AND len(correct) >= 2 ELSE len(o) = 4 AND len(correct) <= 1 END),
    {name} AS MATERIALIZED (SELECT image_id, attempt, '{level}' AS level, '{q}' question_type, replace(replace(replace({say}, '{{a}}', coalesce(a, '')), '{{b}}', coalesce(b, '')), '{{c}}', coalesce(c, '')) question,
      array_to_string(list_transform(o, lambda x, i: chr(64 + i::INT) || '. ' || x.t), '|') options,
      CASE WHEN len(correct) = 0 THEN 'cannot_be_determined' ELSE array_to_string(list_transform(at_, lambda i: chr(65 + i::INT)), ',') END answer,
      CASE WHEN len(correct) = 0 THEN 'cannot_be_determined' ELSE array_to_string(list_transform(at_, lambda i: o[i + 1].t), '|') END answer_text,
      array_to_string(at_, ',') correct_option_indices, CASE WHEN multi THEN 'multi_select' ELSE 'single_choice' END answer_type, metadata FROM {name}_v)"""


def _final(name: str, parts: list[str]) -> str:
    """name: the first whole question of each graph."""
    union = " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)
    return f", {name} AS (SELECT u.* EXCLUDE (attempt), 'p' || (image_id % 97) paper_id FROM ({union}) u QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY attempt) = 1)"


_NONE = "NULL::VARCHAR"


def _told(*columns: str) -> str:
    return f"'used_disambiguation=' || ({' OR '.join(columns)})::VARCHAR"


def presence() -> str:
    q, sql = "element_presence_mcq", ""
    sql += _drawn("p_d", "disp", q, ["id"])
    for n, first in (("p1", True), ("p2", False)):
        sql += _at(f"{n}_a", "p_d", first, "p1_q") + f", {n}_k AS (SELECT a.image_id, attempt, text shown, ks FROM {n}_a a JOIN kk USING (image_id))"
        sql += _ranked(f"{n}_r", f"{n}_k", "nodes", f"NOT list_contains(t.ks, c.key) AND c.key <> lower(t.shown){NEAR}", False)
        sql += f", {n}_c AS (SELECT a.image_id, a.attempt, [text] correct, {_diverse('found', '3')} wrong, {_NONE} a, {_NONE} b, {_NONE} c, {_told('told')} metadata FROM {n}_a a LEFT JOIN {n}_r r ON r.image_id = a.image_id AND r.attempt = a.attempt)"
        sql += _made(f"{n}_q", f"{n}_c", q, "L1", [q])
    return sql + _final("presence", ["p1_q", "p2_q"])


def absence() -> str:
    q, sql = "element_absence_mcq", ""
    sql += ", a_s AS (SELECT * FROM disp JOIN us USING (image_id) WHERE usable >= 3)" + _drawn("a_d", "a_s", q, ["id"])
    for n, first in (("a1", True), ("a2", False)):
        sql += _at(f"{n}_a", "a_d", first, "a1_q") + f", {n}_k AS (SELECT a.image_id, attempt, text shown, ks FROM {n}_a a JOIN kk USING (image_id))"
        sql += _ranked(f"{n}_r", f"{n}_k", "nodes", "NOT list_contains(t.ks, c.key) AND c.key <> lower(t.shown)", False)
        sql += f", {n}_b AS (SELECT image_id, attempt, found[1].t shown FROM {n}_r)"
        sql += _ranked(f"{n}_w", f"{n}_b", "own_texts", f"c.key <> lower(t.shown){NEAR}", True)
        sql += f", {n}_c AS (SELECT a.image_id, a.attempt, [a.shown] correct, {_diverse('found', '3')} wrong, {_NONE} a, {_NONE} b, {_NONE} c, '' metadata FROM {n}_b a LEFT JOIN {n}_w r ON r.image_id = a.image_id AND r.attempt = a.attempt)"
        sql += _made(f"{n}_q", f"{n}_c", q, "L1", [q])
    return sql + _final("absence", ["a1_q", "a2_q"])


def _abstain(p: str, name: str, q: str, edges: str, forward: bool, reason: str) -> str:
    """Prefix p keeps the names of two such types apart."""
    id_, other = ("subject_id", "object_id") if forward else ("object_id", "subject_id")
    coin = f"substr({_key(repr(q), 'image_id', 'attempt', repr('coin'))}, 1, 8) > '80000000'"
    sql = f""", {p}e AS (SELECT d.* FROM disp d JOIN us USING (image_id) WHERE usable >= 4),
    {p}y AS (SELECT x.image_id, x.id, x.text, x.told, o.text other_text, o.told other_told FROM (SELECT image_id, {id_} id, any_value({other}) other FROM {edges} GROUP BY 1, 2 HAVING count(*) = 1) s
      JOIN {p}e x ON x.image_id = s.image_id AND x.id = s.id JOIN disp o ON o.image_id = s.image_id AND o.id = s.other),
    {p}n AS (SELECT x.image_id, x.id, x.text, x.told FROM {p}e x WHERE NOT EXISTS (SELECT 1 FROM {edges} s JOIN disp o ON o.image_id = s.image_id AND o.id = s.object_id WHERE s.image_id = x.image_id AND s.subject_id = x.id))"""
    sql += _drawn(f"{p}yd", f"{p}y", q, ["id"]) + _drawn(f"{p}nd", f"{p}n", q, ["id"])
    source, target = ("text", "other_text") if forward else ("other_text", "text")
    done = f"(SELECT image_id FROM {p}1yq UNION ALL SELECT image_id FROM {p}1nq)"
    for n, first in ((f"{p}1", True), (f"{p}2", False)):
        sql += _at(f"{n}ya", f"{p}yd", first, done, True, coin) + f", {n}yk AS (SELECT image_id, attempt, {target} shown, lower({source}) shut FROM {n}ya)"
        sql += _ranked(f"{n}yr", f"{n}yk", "own_texts", "c.key <> lower(t.shown) AND c.key <> t.shut", True)
        sql += f""", {n}yc AS (SELECT a.image_id, a.attempt, [{target}] correct, {_diverse('found', '3')} wrong, {source} a, {_NONE} b, {_NONE} c, 'is_unanswerable=false; ' || {_told('told', 'other_told')} metadata
          FROM {n}ya a LEFT JOIN {n}yr r ON r.image_id = a.image_id AND r.attempt = a.attempt)"""
        sql += _made(f"{n}yq", f"{n}yc", q, "L2", [q])
        sql += _at(f"{n}na", f"{p}nd", first, done, True, f"NOT EXISTS (SELECT 1 FROM {n}yq m WHERE m.image_id = d.image_id AND m.attempt = r.attempt)")
        sql += f", {n}nk AS (SELECT image_id, attempt, text shown FROM {n}na)" + _ranked(f"{n}nr", f"{n}nk", "own_texts", "c.key <> lower(t.shown)", True)
        sql += f""", {n}nc AS (SELECT a.image_id, a.attempt, []::VARCHAR[] correct, {_diverse('found', '4')} wrong, text a, {_NONE} b, {_NONE} c, 'is_unanswerable=true; unanswerable_reason={reason}; ' || {_told('told')} metadata
          FROM {n}na a LEFT JOIN {n}nr r ON r.image_id = a.image_id AND r.attempt = a.attempt)"""
        sql += _made(f"{n}nq", f"{n}nc", q, "L2", [q])
    return sql + _final(name, [f"{p}1yq", f"{p}1nq", f"{p}2yq", f"{p}2nq"])


def successor_abstain() -> str:
    return _abstain("sa", "successor_abstain", "relation_successor_hidden_abstain_mcq", "flow", True, "no_usable_successor")


def containment_abstain() -> str:
    return _abstain("ca", "containment_abstain", "relation_containment_hidden_abstain_mcq", "holds", False, "no_usable_child")


def _multi(p: str, name: str, q: str, edges: str, count: str, shown: str, id_: str) -> str:
    sql = f""", {p}l AS (SELECT s.image_id, s.subject_id id, list(o.text ORDER BY s.ord, o.text) l FROM {edges} s JOIN disp o ON o.image_id = s.image_id AND o.id = s.object_id GROUP BY 1, 2 HAVING count(*) >= 2),
    {p}s AS (SELECT d.image_id, d.id, d.text, d.told, list_filter(l, lambda x, i: list_position(l, x) = i) every FROM {p}l s JOIN disp d ON d.image_id = s.image_id AND d.id = s.id JOIN us ON us.image_id = d.image_id WHERE usable >= 5)"""
    sql += _drawn(f"{p}d", f"{p}s", q, ["id"])
    for n, first in ((f"{p}1", True), (f"{p}2", False)):
        sql += _at(f"{n}a", f"{p}d", first, f"{p}1q") + f", {n}k AS (SELECT image_id, attempt, every[1] shown, list_append(list_transform(every, lambda x: lower(x)), lower(text)) shut FROM {n}a)"
        sql += _ranked(f"{n}r", f"{n}k", "own_texts", "NOT list_contains(t.shut, c.key)", True)
        sql += f""", {n}w AS (SELECT a.*, every[1:4] correct, {_diverse('found', 'greatest(1, 4 - len(every))')} wrong_ FROM {n}a a LEFT JOIN {n}r r ON r.image_id = a.image_id AND r.attempt = a.attempt),
        {n}c AS (SELECT image_id, attempt, correct, wrong_[1:least(6, greatest(4, len(correct) + 2)) - len(correct)] wrong, text a, {_NONE} b, {_NONE} c,
          array_to_string(list_sort(['{count}=' || len(correct), '{shown}=' || text, '{id_}=' || id, {_told('told')}]), '; ') metadata FROM {n}w)"""
        sql += _made(f"{n}q", f"{n}c", q, "L2", [q], "true")
    return sql + _final(name, [f"{p}1q", f"{p}2q"])


def successor_multi() -> str:
    return _multi("sm", "successor_multi", "relation_successor_multiselect", "flow", "successor_count", "src_display", "src_id")


def containment_multi() -> str:
    return _multi("cm", "containment_multi", "relation_containment_multiselect", "holds", "child_count", "container_display", "container_id")


def edge_label() -> str:
    q = "relation_edge_label_hidden_abstain_mcq"
    coin = f"substr({_key(repr(q), 'image_id', 'attempt', repr('coin'))}, 1, 8) > '80000000'"
    luck = _number(_key(repr(q), "image_id", "attempt", "'like'"))
    sql = """, ely AS (SELECT s.image_id, s.ord, s.edge_text label, x.text a, y.text b, x.told OR y.told told FROM named s JOIN disp x ON x.image_id = s.image_id AND x.id = s.subject_id JOIN disp y ON y.image_id = s.image_id AND y.id = s.object_id
      WHERE (SELECT count(*) FROM lp) >= 4),
    eln AS (SELECT x.image_id, x.id a_id, y.id b_id, x.text a, y.text b, x.told OR y.told told FROM disp x JOIN disp y ON x.image_id = y.image_id AND x.id <> y.id WHERE (SELECT count(*) FROM lp) >= 4
      AND x.image_id IN (SELECT image_id FROM named) AND NOT EXISTS (SELECT 1 FROM named s WHERE s.image_id = x.image_id AND s.subject_id = x.id AND s.object_id = y.id)), lpl AS (SELECT list(shown ORDER BY shown) every FROM lp)"""
    sql += _drawn("elyd", "ely", q, ["ord"]) + _drawn("elnd", "eln", q, ["a_id", "b_id"])
    done = "(SELECT image_id FROM el1yq UNION ALL SELECT image_id FROM el1nq)"
    for n, first in (("el1", True), ("el2", False)):
        sql += _at(f"{n}ya", "elyd", first, done, True, coin) + f", {n}yk AS (SELECT image_id, attempt, label shown FROM {n}ya)" + _ranked(f"{n}yr", f"{n}yk", "labels", "c.key <> lower(t.shown)", False)
        sql += f", {n}yc AS (SELECT a.image_id, a.attempt, [label] correct, {_diverse('found', '3')} wrong, a, b, {_NONE} c, 'is_unanswerable=false; ' || {_told('told')} metadata FROM {n}ya a LEFT JOIN {n}yr r ON r.image_id = a.image_id AND r.attempt = a.attempt)"
        sql += _made(f"{n}yq", f"{n}yc", q, "L2", [q])
        sql += _at(f"{n}na", "elnd", first, done, True, f"NOT EXISTS (SELECT 1 FROM {n}yq m WHERE m.image_id = d.image_id AND m.attempt = r.attempt)")
        sql += f", {n}nk AS (SELECT image_id, attempt, every[({luck} % len(every) + 1)::INT] shown FROM {n}na, lpl)" + _ranked(f"{n}nr", f"{n}nk", "labels", "c.key <> lower(t.shown)", False)
        sql += f""", {n}nc AS (SELECT a.image_id, a.attempt, []::VARCHAR[] correct, {_diverse('found', '4')} wrong, a, b, {_NONE} c, 'is_unanswerable=true; unanswerable_reason=no_edge_label; ' || {_told('told')} metadata
          FROM {n}na a LEFT JOIN {n}nr r ON r.image_id = a.image_id AND r.attempt = a.attempt)"""
        sql += _made(f"{n}nq", f"{n}nc", q, "L2", [q])
    return sql + _final("edge_label", ["el1yq", "el1nq", "el2yq", "el2nq"])


def multihop() -> str:
    """Recursion is over the edges within scopes; a path's texts come from one row per node of it."""
    q = "relation_multihop_multiselect"
    scope_key = _key(f"'{q}'", "image_id", "scope")
    least = "greatest(1, 4 - len(between))"
    sql = TOP + f""", scp AS MATERIALIZED (SELECT t.image_id, '' AS scope, t.id FROM top t JOIN disp USING (image_id, id) UNION SELECT h.image_id, h.subject_id, h.object_id FROM holds h JOIN disp d ON d.image_id = h.image_id AND d.id = h.object_id),
    big AS (SELECT image_id, scope FROM scp GROUP BY 1, 2 HAVING count(*) >= 3),
    hop AS MATERIALIZED (SELECT s.image_id, s.scope, f.subject_id, f.object_id FROM flow f JOIN scp s ON s.image_id = f.image_id AND s.id = f.subject_id JOIN scp o ON o.image_id = f.image_id AND o.id = f.object_id AND o.scope = s.scope JOIN big ON big.image_id = s.image_id AND big.scope = s.scope),
    trek AS (SELECT image_id, scope, subject_id src, object_id tgt, [subject_id, object_id] path FROM hop
      UNION ALL SELECT w.image_id, w.scope, src, h.object_id, list_append(path, h.object_id) FROM trek w JOIN hop h ON h.image_id = w.image_id AND h.scope = w.scope AND h.subject_id = w.tgt WHERE len(path) < 5 AND NOT list_contains(path, h.object_id)),
    mp AS (SELECT image_id, scope, src, tgt, any_value(path) path FROM trek GROUP BY ALL HAVING count(*) = 1 AND len(any_value(path)) >= 3),
    least_box AS (SELECT image_id, scope, src, tgt, min(box) box FROM (SELECT m.image_id, m.scope, m.src, m.tgt, h.subject_id box FROM (SELECT *, unnest(path) node FROM mp WHERE scope <> '') m JOIN (SELECT DISTINCT image_id, subject_id, object_id FROM holds) h ON h.image_id = m.image_id AND h.object_id = m.node
      GROUP BY ALL HAVING count(*) = len(any_value(m.path))) GROUP BY ALL),
    mn AS (SELECT m.image_id, m.scope, m.src, m.tgt, any_value(m.path) path, list(d.text ORDER BY p) texts, list(d.told ORDER BY p) tolds, list(d.refs ORDER BY p) refs FROM (SELECT *, unnest(path) node, generate_subscripts(path, 1) p FROM mp) m JOIN disp d ON d.image_id = m.image_id AND d.id = m.node
      GROUP BY ALL HAVING count(*) = len(any_value(m.path))),
    mg AS (SELECT m.*, texts[2:-2] between, path[2:-2] middle, b.text box_text FROM mn m LEFT JOIN disp b ON b.image_id = m.image_id AND b.id = m.scope LEFT JOIN least_box x ON x.image_id = m.image_id AND x.scope = m.scope AND x.src = m.src AND x.tgt = m.tgt
      WHERE m.scope = '' OR (b.text IS NOT NULL AND x.box = m.scope)),
    mo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY scope <> '', len(path) DESC, {scope_key}, src, tgt) - 1 attempt FROM mg WHERE NOT list_has_any(list_concat(refs[1], refs[-1]), middle)
      AND len(list_filter(between, lambda x: contains(lower(texts[1]), lower(x)) OR contains(lower(texts[-1]), lower(x)))) = 0),
    mk AS (SELECT image_id, attempt, between[1] shown, list_transform(texts, lambda x: lower(x)) shut, path, scope FROM mo)"""
    own = "NOT list_contains(t.shut, c.key) AND EXISTS (SELECT 1 FROM disp d{0} WHERE d.image_id = t.image_id AND d.text = c.shown AND NOT list_contains(t.path, d.id){1})"
    sql += _ranked("mr1", "mk", "own_texts", own.format(" JOIN scp s ON s.image_id = d.image_id AND s.id = d.id", " AND s.scope = t.scope") + NEAR, True)
    sql += f", mw1 AS (SELECT m.*, {_diverse('found', least)} picked FROM mo m LEFT JOIN mr1 r ON r.image_id = m.image_id AND r.attempt = m.attempt)"
    shut = "list_concat(list_transform(texts, lambda x: lower(x)), list_transform(picked, lambda x: lower(x)))"
    sql += f", mk2 AS (SELECT image_id, attempt, between[1] shown, {shut} shut, path, scope FROM mw1)" + _ranked("mr2", "mk2", "own_texts", own.format("", "") + NEAR, True)
    sql += f", mw2 AS (SELECT m.* EXCLUDE (picked), list_concat(picked, {_diverse('found', f'({least} - len(picked))')}) picked FROM mw1 m LEFT JOIN mr2 r ON r.image_id = m.image_id AND r.attempt = m.attempt)"
    sql += f", mk3 AS (SELECT m.image_id, attempt, between[1] shown, list_concat({shut}, ks) shut FROM mw2 m JOIN kk USING (image_id))" + _ranked("mr3", "mk3", "nodes", f"NOT list_contains(t.shut, c.key){NEAR}", False)
    sql += f""", mw3 AS (SELECT m.* EXCLUDE (picked), list_concat(picked, {_diverse('found', f'({least} - len(picked))')}) picked FROM mw2 m LEFT JOIN mr3 r ON r.image_id = m.image_id AND r.attempt = m.attempt),
    mc AS (SELECT image_id, attempt, between correct, picked[1:least(6, greatest(4, len(between) + 2)) - len(between)] wrong, texts[1] a, texts[-1] b, box_text c,
      concat_ws('; ', 'intermediate_displays=' || to_json(between)::VARCHAR, 'intermediate_node_ids=' || to_json(middle)::VARCHAR, 'path_node_ids=' || to_json(path)::VARCHAR, 'path_scope=' || CASE WHEN scope = '' THEN 'top_level_only' ELSE 'local_container' END, 'path_unique=true',
        'scope_container=' || box_text, 'scope_container_id=' || nullif(scope, ''), 'src_display=' || texts[1], 'src_id=' || src, 'tgt_display=' || texts[-1], 'tgt_id=' || tgt, 'used_disambiguation=' || list_bool_or(tolds)::VARCHAR) metadata FROM mw3)"""
    sql = sql.replace("list_bool_or(tolds)", "list_contains(tolds, true)")
    sql += _made("mq", "mc", q, "L2", ["relation_multihop_top", "relation_multihop_container"], "len(correct) > 1")
    return sql + _final("multihop", ["mq"])


def conflict() -> str:
    q = "relation_conflict_mcq"
    sql = """, cs AS (SELECT r.image_id, lower(x.text || ' ' || predicate || ' ' || y.text) k, arg_min(x.text || ' ' || predicate || ' ' || y.text, r.ord) AS text, bool_or(is_conflict) bad
      FROM rel r JOIN disp x ON x.image_id = r.image_id AND x.id = r.subject_id JOIN disp y ON y.image_id = r.image_id AND y.id = r.object_id GROUP BY 1, 2), cb AS (SELECT image_id, text FROM cs WHERE bad)"""
    sql += _drawn("cfd", "cb", q, ["text"])
    for n, first in (("cf1", True), ("cf2", False)):
        sql += _at(f"{n}a", "cfd", first, "cf1q")
        sql += f", {n}w AS (SELECT a.image_id, attempt, a.text, list(s.text ORDER BY {_key(repr(q), 'a.image_id', 'attempt', 's.text')}, s.text) others FROM {n}a a JOIN cs s ON s.image_id = a.image_id AND s.text <> a.text GROUP BY ALL)"
        sql += f", {n}c AS (SELECT image_id, attempt, [text] correct, others[1:3] wrong, {_NONE} a, {_NONE} b, {_NONE} c, '' metadata FROM {n}w)" + _made(f"{n}q", f"{n}c", q, "L3", [q])
    return sql + _final("conflict", ["cf1q", "cf2q"])


def summary() -> str:
    q = "function_summary_open"
    phrases = "[" + ", ".join(map(_quoted, SAY[q])) + "]"
    pick = f"{phrases}[({_number(_key(repr(q), 'image_id', repr('0'), repr('phrase')))} % {len(SAY[q])} + 1)::INT]"
    return f""", summary AS (SELECT image_id, 'L3' AS level, '{q}' question_type, {pick} question, '' options, said answer, said answer_text, NULL::VARCHAR correct_option_indices, 'open' answer_type, '' metadata, 'p' || (image_id % 97) paper_id
      FROM (SELECT g image_id, 'Order with ' || count(*) || ' parts' said FROM n GROUP BY 1))"""


TYPES = {f.__name__: f for f in (presence, absence, successor_abstain, successor_multi, containment_abstain, containment_multi, edge_label, multihop, conflict, summary)}


def oracle_sql() -> dict[str, str]:
    found = {f"q_{name}": BASE + make() + f" SELECT {COLUMNS} FROM {name}" for name, make in TYPES.items()}
    every = BASE + "".join(make() for make in TYPES.values()) + ", every AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {COLUMNS} FROM {name}" for name in TYPES) + ")"
    found["summary_grouping_sets"] = every + " SELECT level, question_type, answer_type, count(*) n, count(DISTINCT image_id) graphs FROM every GROUP BY GROUPING SETS ((level), (question_type), (answer_type), ())"
    fault = """CASE WHEN NOT spoiled OR answer_type = 'open' THEN NULL WHEN image_id % 6 = 1 THEN 'duplicate option texts' WHEN image_id % 6 = 2 THEN 'duplicate option labels' WHEN image_id % 6 = 3 THEN 'index out of range'
      WHEN image_id % 6 = 4 AND correct_option_indices = '' THEN 'no index but an answer' WHEN image_id % 6 = 4 THEN 'answer labels mismatch' WHEN image_id % 6 = 5 THEN 'options missing or too few' END"""
    found["validation_verdicts"] = every + f", v AS (SELECT question_type, spoiled, {fault} reason FROM every, (VALUES (false), (true)) s(spoiled)) SELECT question_type, spoiled, reason IS NULL ok, reason, count(*) n FROM v GROUP BY ALL"
    found["diverse_top_k"] = (
        GRAPHS + WORDS + HINT + ", candidates0 AS (SELECT DISTINCT ON (image_id, norm_text) image_id, norm_text key, shown FROM ent WHERE " + _safe("shown") + " ORDER BY image_id, norm_text, shown)" + _signed("cand", "candidates0")
        + ", targets AS (SELECT image_id, id attempt, shown, norm_text FROM ent)" + _ranked("picks", "targets", "cand", f"c.key <> t.norm_text{NEAR}", True)
        + f" SELECT e.image_id, e.id, array_to_string({_diverse('found', '3')}, '|') picked FROM ent e LEFT JOIN picks r ON r.image_id = e.image_id AND r.attempt = e.id"
    )
    # each split by itself: graphs, pools and all that follows hold its orders only
    split = "SELECT g FROM (SELECT g, row_number() OVER (ORDER BY md5('42|' || g), g) i, count(*) OVER () k FROM (SELECT DISTINCT l_orderkey g FROM lineitem JOIN part ON p_partkey = l_partkey)) WHERE {0}"
    train, val = "floor(k * 0.8::DOUBLE)", "floor(k * 0.1::DOUBLE)"
    cuts = {"train": f"i <= {train}", "val": f"i > {train} AND i <= {train} + {val}", "test": f"i > {train} + {val}"}
    types = (presence, edge_label, summary)
    each = " UNION ALL ".join(f"SELECT {COLUMNS} FROM {f.__name__}" for f in types)
    parts = [f"SELECT '{name}' AS split, * FROM (" + BASE.replace("FROM lineitem GROUP BY", f"FROM lineitem WHERE l_orderkey IN ({split.format(cut)}) GROUP BY") + "".join(f() for f in types) + " " + each + ")" for name, cut in cuts.items()]
    found["dataset_by_split"] = " UNION ALL ".join(parts)
    return found
