"""DuckDB SQL with the results of the queries of the catalogue, written from their rules."""

from __future__ import annotations

from ..functions.text import CONNECTIVES, DOMAINS, KEYWORD_STOPWORDS, LONGEST, STOPWORDS, SUFFIXES
from ..operators.replies import ABSTAIN, ANCHOR, NEGATION, STATED, UNITS
from ..sources.tables import PHRASES


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


GRAPHS = r"""
WITH RECURSIVE g0 AS (SELECT l_orderkey g, l_partkey p, min(l_linenumber) ln, max(l_returnflag) rf, max(l_linestatus) ls, max(l_discount) d FROM lineitem GROUP BY 1, 2),
g1 AS (SELECT *, row_number() OVER w rn, lead(p) OVER w nx, lead(p, 2) OVER w nx2 FROM g0 WINDOW w AS (PARTITION BY g ORDER BY ln, p)),
n AS (SELECT g1.*, p_name, p_brand, CASE WHEN rn % 2 = 0 THEN lower(rf || ' ' || ls) ELSE '' END label, 'c' || replace(p_brand, '#', '') box FROM g1 JOIN part ON p_partkey = p),
e AS (SELECT g image_id, rn - 1 ord, 'e' || p id, p_name text, 'Node' AS type FROM n
  UNION ALL SELECT g, 999 + row_number() OVER (PARTITION BY g ORDER BY p_brand), box, p_brand, 'Container' FROM (SELECT DISTINCT g, p_brand, box FROM n)),
ent AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS shown, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) norm_text FROM e),
rel AS (SELECT g image_id, rn * 2 ord, 'e' || p subject_id, 'flows_to' predicate, 'e' || nx object_id, label edge_text, d >= 0.09 is_conflict FROM n WHERE nx IS NOT NULL
  UNION ALL SELECT g, rn * 2 + 1, 'e' || p, 'flows_to', 'e' || nx2, label, d >= 0.09 FROM n WHERE nx2 IS NOT NULL AND rn % 3 = 0
  UNION ALL SELECT g, rn + 10000, box, 'contains', 'e' || p, '', false FROM n),
flow AS (SELECT * FROM rel WHERE predicate = 'flows_to' AND NOT is_conflict),
holds AS (SELECT * FROM rel WHERE predicate = 'contains' AND NOT is_conflict)
"""

TOP = """, inside AS MATERIALIZED (SELECT DISTINCT image_id, object_id id FROM holds), top AS MATERIALIZED (SELECT ent.* FROM ent ANTI JOIN inside USING (image_id, id)),
fed AS MATERIALIZED (SELECT DISTINCT f.image_id, f.object_id id FROM flow f JOIN top u ON u.image_id = f.image_id AND u.id = f.subject_id), root AS MATERIALIZED (SELECT top.* FROM top ANTI JOIN fed USING (image_id, id))
"""

PATHS = """, walk AS (SELECT image_id, subject_id src, object_id tgt, [subject_id, object_id] path, [ord] ords, 1 hops FROM flow
  UNION ALL SELECT w.image_id, src, f.object_id, list_append(path, f.object_id), list_append(ords, f.ord), hops + 1 FROM walk w JOIN flow f ON f.image_id = w.image_id AND f.subject_id = w.tgt WHERE hops < 4 AND NOT list_contains(path, f.object_id))
"""

WORDS = f""", texts AS (SELECT image_id, ord, text FROM ent UNION ALL SELECT g, -1, 'Order with ' || count(*) || ' parts' FROM n GROUP BY g),
toks AS (SELECT image_id, ord, regexp_extract_all(lower(text), '[a-z0-9]+') l FROM texts),
word AS (SELECT image_id, ord, unnest(l) word, generate_subscripts(l, 1) pos FROM toks),
counted AS (SELECT image_id, word, count(*) n, min(ord * 100000 + pos) first FROM word WHERE length(word) >= 3 AND NOT list_contains({_list(STOPWORDS)}, word) GROUP BY 1, 2),
top12 AS (SELECT image_id, word, n, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first) AS rank FROM counted QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first) <= 12),
bag AS (SELECT g.image_id, list(word) FILTER (word IS NOT NULL) l FROM (SELECT DISTINCT image_id FROM ent) g LEFT JOIN top12 USING (image_id) GROUP BY 1)
"""


def _domains(words: str) -> str:
    some = ", ".join(f"CASE WHEN list_has_any(coalesce({words}, []), {_list(DOMAINS[k])}) THEN '{k}' END" for k in sorted(DOMAINS))
    return f"coalesce(nullif(concat_ws(',', {some}), ''), 'unknown')"


HINT = f", hint AS (SELECT image_id, {_domains('l')} domains FROM bag)"


def _signature(x: str) -> dict[str, str]:
    parts = f"list_filter(regexp_split_to_array(lower({x}), '[\\s\\-/_,:;()]+'), lambda t: t <> '')"
    last = f"list_extract(string_split(lower({x}), ' '), -1)"
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in SUFFIXES.items())
    return {
        "token_count": f"len({parts})", "char_length": f"length({x})", "has_hyphen": f"contains({x}, '-')", "suffix_type": f"coalesce((MAP {{{pairs}}})[{last}], 'other')",
        "keywords": f"list_sort(list_distinct(list_filter({parts}, lambda t: length(t) >= 3 AND NOT list_contains({_list(KEYWORD_STOPWORDS)}, t))))",
    }


def _sig(name: str, source: str) -> str:
    s = _signature("shown")
    return f", {name} AS (SELECT *, {', '.join(f'{v} {k}' for k, v in s.items())} FROM {source}), {name}d AS (SELECT *, {_domains('keywords')} own FROM {name})"


SCORE = """0.0::DOUBLE - abs(t.token_count - c.token_count) * 1.2::DOUBLE - abs(t.char_length - c.char_length) * 0.08::DOUBLE + CASE WHEN t.has_hyphen = c.has_hyphen THEN 0.8::DOUBLE ELSE 0 END
  + CASE WHEN t.suffix_type = c.suffix_type AND t.suffix_type <> 'other' THEN 2.5::DOUBLE WHEN t.suffix_type <> 'other' AND c.suffix_type <> 'other' THEN 0.5::DOUBLE ELSE 0 END
  + len(list_intersect(t.keywords, c.keywords)) * 0.8::DOUBLE + CASE WHEN list_has_any(string_split(h.domains, ','), string_split(c.own, ',')) THEN 1.5::DOUBLE ELSE 0 END
  + CASE WHEN c.token_count <= 6 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END"""


def _safe(x: str) -> str:
    return " AND ".join([f"{x} <> ''", f"length({x}) <= {LONGEST}", *[f"len(string_split({x}, '{c}')) <= 2" for c in CONNECTIVES]])


DISPLAY = f""", cnt AS (SELECT *, count(*) OVER (PARTITION BY image_id, norm_text) k FROM ent),
known AS (SELECT image_id, id, shown ref FROM cnt WHERE k = 1 AND {_safe("shown")}),
pred AS (SELECT f.image_id, f.object_id id, f.ord, f.subject_id r, ref FROM flow f JOIN known ON known.image_id = f.image_id AND known.id = f.subject_id),
succ AS (SELECT f.image_id, f.subject_id id, f.ord, f.object_id r, ref FROM flow f JOIN known ON known.image_id = f.image_id AND known.id = f.object_id),
box AS (SELECT h.image_id, h.object_id id, h.ord, h.subject_id r, ref FROM holds h JOIN known ON known.image_id = h.image_id AND known.id = h.subject_id),
ways AS (SELECT image_id, id, ' inside ' || ref tail, 0 kind, ord o1, 0 o2, [r] refs FROM box UNION ALL SELECT image_id, id, ' immediately after ' || ref, 1, ord, 0, [r] FROM pred
  UNION ALL SELECT image_id, id, ' immediately before ' || ref, 2, ord, 0, [r] FROM succ
  UNION ALL SELECT p.image_id, p.id, ' between ' || p.ref || ' and ' || s.ref, 3, p.ord, s.ord, [p.r, s.r] FROM pred p JOIN succ s ON p.image_id = s.image_id AND p.id = s.id WHERE lower(p.ref) <> lower(s.ref)),
told AS (SELECT c.image_id, c.id, c.norm_text, c.shown || tail phrase, kind, o1, o2, refs FROM cnt c JOIN ways USING (image_id, id) WHERE k > 1 AND norm_text <> ''),
once AS (SELECT *, lower(phrase) key FROM told WHERE {_safe("phrase")} QUALIFY row_number() OVER (PARTITION BY image_id, id, lower(phrase) ORDER BY kind, o1, o2) = 1),
own AS (SELECT * FROM once QUALIFY count(*) OVER (PARTITION BY image_id, norm_text, key) = 1),
pick AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY image_id, id ORDER BY kind, o1, o2) = 1),
placed AS (SELECT c.*, phrase, refs, count(phrase) OVER (PARTITION BY c.image_id, c.norm_text) m FROM cnt c LEFT JOIN pick USING (image_id, id)),
shown_map AS (SELECT *, k = 1 AND {_safe("shown")} alone, k > 1 AND norm_text <> '' AND m = k AS told_ok FROM placed)
"""

_KINDS = [
    "'The answer is ' || x || '.'", "x || '.'", "'(' || x || ')'", "'**' || x || '**'", "ph", "'It is not the ' || ph", "'Some noise near the ' || ph", "'This cannot be determined.'", "'None of the above.'", "'A. or B.'", "''",
]
REPLIES = f"""
WITH r0 AS (SELECT o_orderkey k, o_custkey c, o_orderpriority model, substr('ABCD', (o_custkey % 4 + 1)::INT, 1) x, list_extract({_list(PHRASES)}, (o_custkey % 4 + 1)::INT) ph FROM orders),
r AS (SELECT k sample_id, model, 'L' || (k % 3 + 1) AS level, 'type_' || (k % 4) question_type, CASE WHEN k % 11 = 0 THEN 'open' ELSE 'single_choice' END answer_type, k % 5 = 0 is_unanswerable,
  substr('ABCD', ((k + c) % 4 + 1)::INT, 1) gold, CASE c % 12 {' '.join(f'WHEN {i} THEN {t}' for i, t in enumerate(_KINDS))} ELSE 'Lovely weather today' END raw, CASE WHEN k % 97 = 0 THEN 'timeout' END error,
  CASE WHEN k % 13 <> 0 THEN k % 50 END prompt_tokens, CASE WHEN k % 13 <> 0 THEN k % 20 END completion_tokens, k % 2 = 0 good_judge, x,
  CASE WHEN k % 11 = 0 AND k % 3 <> 0 THEN (k % 3 + k % 2 + (k // 2) % 3) * {UNITS // 6} END opened FROM r0),
s1 AS (SELECT *, regexp_matches(raw, {_quoted(ABSTAIN)}) abstains, upper(list_extract(regexp_extract_all(raw, {_quoted(STATED)}, 1), -1)) stated, nullif(upper(regexp_extract(raw, '(?i)^\\W*([ABCD])\\W*$', 1)), '') lone,
  list_distinct(regexp_extract_all(regexp_replace(raw, '(^|[^A-Za-z])([A-D])', '\\1' || chr(1) || '\\2', 'g'), chr(1) || '([ABCD])(?:\\)|\\*\\*|[.\\]:])', 1)) marked,
  trim(regexp_replace(regexp_replace(lower(raw), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) nr FROM r),
s2 AS (SELECT *, coalesce(nullif(stated, ''), lone, CASE WHEN len(marked) = 1 THEN marked[1] END) letter1,
  list_filter([{', '.join(f"CASE WHEN strpos(nr, '{p}') > 0 AND NOT regexp_matches(substr(nr, greatest(1, strpos(nr, '{p}') - 40), strpos(nr, '{p}') - greatest(1, strpos(nr, '{p}') - 40)), {_quoted(NEGATION)}) THEN '{'ABCD'[i]}' END" for i, p in enumerate(PHRASES))}], lambda h: h IS NOT NULL) hits FROM s1),
s3 AS (SELECT *, CASE WHEN len(hits) = 1 THEN hits[1] END letter2 FROM s2),
s4 AS (SELECT *, CASE WHEN abstains THEN 'abstain_rule' WHEN letter1 IS NOT NULL THEN 'regex' WHEN letter2 IS NOT NULL THEN 'substring' ELSE 'judge' END stage FROM s3),
parsed AS (SELECT *, CASE WHEN answer_type <> 'open' THEN stage END parse_stage,
  CASE WHEN answer_type = 'open' THEN NULL WHEN stage = 'abstain_rule' THEN 'abstained' WHEN stage <> 'judge' OR good_judge THEN 'selected' ELSE 'invalid' END parse_action,
  CASE WHEN answer_type = 'open' THEN NULL WHEN stage = 'regex' THEN letter1 WHEN stage = 'substring' THEN letter2 WHEN stage = 'judge' AND good_judge THEN x END letters FROM s4),
scored AS (SELECT *, CASE WHEN answer_type = 'open' THEN NULL WHEN parse_action = 'abstained' THEN is_unanswerable::BIGINT WHEN parse_action = 'invalid' THEN 0 ELSE (NOT is_unanswerable AND letters = gold)::BIGINT END correct FROM parsed),
u AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN answer_type = 'open' THEN opened ELSE correct * {UNITS} END units, error IS NULL AND answer_type <> 'open' closed FROM scored)
"""

_ANCHORED = f"""
WITH r0 AS (SELECT o_orderkey k, ['The correct options are A, B.', 'The correct options are B and C.', 'Answers: A, D' || chr(10) || 'I first thought the answers are B.', 'The correct options are A because it is red.', 'None of the given fit.', 'Selected options: (B), (D) & E; sure'][(o_orderkey % 6 + 1)::INT] raw,
  CASE WHEN o_orderkey % 2 = 0 THEN ['A', 'B'] ELSE ['B', 'C', 'D'] END gold, o_orderkey % 2 = 0 good_judge FROM orders),
p0 AS (SELECT *, string_split(regexp_replace(raw, {_quoted(ANCHOR)}, chr(1), 'g'), chr(1)) parts FROM r0),
p1 AS (SELECT *, unnest(parts) part, generate_subscripts(parts, 1) i FROM p0),
p2 AS (SELECT *, regexp_split_to_array(substr(part, 1, 90), '[.\\n;]') tail FROM p1),
p3 AS (SELECT *, upper(tail[1]) head FROM p2 WHERE i > 1 AND (len(tail) > 1 OR length(part) >= 90 OR i = len(parts)) AND trim(regexp_replace(tail[1], '(?i)and|&|[ABCDEF,\\s()*]', '', 'g')) = ''),
p4 AS (SELECT k, arg_max(head, i) head FROM p3 WHERE regexp_matches(head, '[ABCDEF]') GROUP BY k),
q AS (SELECT r0.k, gold, good_judge, regexp_matches(raw, {_quoted(ABSTAIN)}) abstains, HEAD head FROM r0 LEFT JOIN p4 ON p4.k = r0.k),
m AS (SELECT *, list_filter(['A', 'B', 'C', 'D', 'E', 'F'], lambda a: contains(head, a)) found, CASE WHEN abstains THEN 'abstain_rule' WHEN head IS NOT NULL THEN 'regex' ELSE 'judge' END stage FROM q),
parsed AS (SELECT k sample_id, gold, stage parse_stage, CASE WHEN stage = 'abstain_rule' THEN 'abstained' WHEN stage = 'regex' OR good_judge THEN 'selected' ELSE 'invalid' END parse_action,
  CASE WHEN stage = 'regex' THEN list_transform(list_sort(list_transform(found, lambda a: struct_pack(p := strpos(head, a), a := a))), lambda s: s.a) WHEN stage = 'judge' AND good_judge THEN ['A', 'AB', 'C'] END letters FROM m)
"""
MULTI = _ANCHORED.replace("HEAD head", "head")
MULTI_FIXED = _ANCHORED.replace("HEAD head", "replace(head, 'AND', ' ') head")


def oracle_sql() -> dict[str, str]:
    edges = "SELECT image_id, {0} id, {1} neighbour FROM {2}"
    unique = "SELECT image_id, {0} id, min({1}) neighbour FROM {2} GROUP BY image_id, {0} HAVING count(*) = 1"
    pool = "SELECT key, arg_min(shown, (image_id, ord)) AS text FROM (SELECT *, lower(shown) key FROM ({0})) WHERE key <> '' GROUP BY key"
    graphs = {
        "entities_normalized": "SELECT image_id, ord, id, text, type, norm_text FROM ent",
        "relations_clean": "SELECT * FROM rel",
        "relation_filters": "SELECT image_id, subject_id, object_id FROM flow",
        "edges_with_text": "SELECT image_id, subject_id, object_id, edge_text FROM rel WHERE edge_text <> '' AND NOT is_conflict",
        "conflict_relations": "SELECT image_id, subject_id, object_id FROM rel WHERE is_conflict",
        "entity_lookup_last_wins": "SELECT image_id, id, arg_max(text, ord) AS text, arg_max(type, ord) AS type FROM ent GROUP BY image_id, id",
        "find_ids_exact": "SELECT image_id, id FROM ent WHERE norm_text = 'brand#11'",
        "find_ids_substring": "SELECT image_id, id FROM ent WHERE contains(norm_text, 'and#2')",
        "edge_text_first": "SELECT image_id, subject_id, object_id, nullif(arg_min(edge_text, ord), '') edge_text FROM rel GROUP BY ALL",
        "successors": edges.format("subject_id", "object_id", "flow"),
        "predecessors": edges.format("object_id", "subject_id", "flow"),
        "children": edges.format("subject_id", "object_id", "holds"),
        "parents": edges.format("object_id", "subject_id", "holds"),
        "pairs_by_predicate": "SELECT image_id, subject_id, object_id FROM rel WHERE predicate = 'flows_to'",
        "unique_successor": unique.format("subject_id", "object_id", "flow"),
        "unique_predecessor": unique.format("object_id", "subject_id", "flow"),
        "unique_parent": unique.format("object_id", "subject_id", "holds"),
        "text_counts": "SELECT image_id, norm_text, count(*) n FROM ent GROUP BY ALL",
        "duplicate_texts": "SELECT image_id, norm_text, count(*) n, string_agg(id, ',' ORDER BY ord, id) ids FROM ent WHERE norm_text <> '' GROUP BY image_id, norm_text HAVING count(*) > 1",
        "node_pool": pool.format("SELECT image_id, ord, shown FROM ent"),
        "edge_label_pool": pool.format("SELECT image_id, ord, edge_text shown FROM rel"),
        "negative_relation_pairs": "SELECT a.image_id, a.id subject_id, b.id object_id FROM ent a JOIN ent b ON a.image_id = b.image_id AND a.id <> b.id WHERE a.type = 'Node' AND b.type = 'Node' AND NOT EXISTS (SELECT 1 FROM rel r WHERE r.image_id = a.image_id AND r.subject_id = a.id AND r.object_id = b.id)",
    }
    found = {k: GRAPHS + v for k, v in graphs.items()}
    found["top_level"] = GRAPHS + TOP + "SELECT image_id, id FROM top"
    found["root_flow"] = GRAPHS + TOP + "SELECT image_id, id FROM root"
    found["main_flow"] = GRAPHS + TOP + """, step AS (SELECT f.image_id, f.subject_id, min(f.object_id) nxt FROM flow f JOIN top a ON a.image_id = f.image_id AND a.id = f.subject_id JOIN top b ON b.image_id = f.image_id AND b.id = f.object_id GROUP BY 1, 2 HAVING count(*) = 1),
      walk AS (SELECT image_id, [arg_min(id, ord)] flow FROM root GROUP BY image_id UNION ALL SELECT w.image_id, list_append(flow, nxt) FROM walk w JOIN step s ON s.image_id = w.image_id AND s.subject_id = flow[-1] WHERE NOT list_contains(flow, nxt) AND len(flow) < 20)
      SELECT image_id, array_to_string(arg_max(flow, len(flow)), '>') AS flow FROM walk GROUP BY image_id"""
    found["shortest_path_le4"] = GRAPHS + PATHS + "SELECT image_id, src, tgt, array_to_string(path, '>') AS path, hops::BIGINT hops FROM walk QUALIFY row_number() OVER (PARTITION BY image_id, src, tgt ORDER BY hops, ords) = 1"
    found["has_path"] = GRAPHS + PATHS + "SELECT image_id, count(DISTINCT (src, tgt)) pairs FROM walk GROUP BY image_id"
    found["unique_multihop_pairs"] = GRAPHS + PATHS + "SELECT w.image_id, src, tgt, array_to_string(any_value(path), '>') AS path FROM walk w JOIN (SELECT image_id FROM ent GROUP BY 1 HAVING count(DISTINCT id) >= 3) USING (image_id) GROUP BY w.image_id, src, tgt HAVING count(*) = 1 AND any_value(hops) >= 2"
    found["graph_keywords_top12"] = GRAPHS + WORDS + "SELECT * FROM top12"
    found["domain_hint"] = GRAPHS + WORDS + HINT + "SELECT image_id, domains FROM hint"
    found["text_signature"] = GRAPHS + ", pooled AS (SELECT text shown FROM (" + pool.format("SELECT image_id, ord, shown FROM ent") + "))" + _sig("s", "pooled") + "SELECT shown AS text, token_count, char_length, has_hyphen, suffix_type, array_to_string(keywords, ' ') keywords, replace(own, ',', ' ') domains FROM sd"
    scoring = GRAPHS + WORDS + HINT + _sig("s", "ent")
    found["candidate_scores"] = scoring + f"SELECT t.image_id, t.id, c.id candidate_id, {SCORE} AS score FROM sd t JOIN sd c ON t.image_id = c.image_id AND t.id <> c.id JOIN hint h ON h.image_id = t.image_id"
    found["ranked_candidates"] = scoring + f""", cand AS (SELECT DISTINCT ON (image_id, norm_text) * FROM sd WHERE {_safe("shown")} ORDER BY image_id, norm_text, shown),
      ranks AS (SELECT t.image_id, t.id, c.shown, {SCORE} AS score FROM sd t JOIN cand c ON t.image_id = c.image_id AND t.norm_text <> c.norm_text JOIN hint h ON h.image_id = t.image_id)
      SELECT ent.image_id, ent.id, coalesce(string_agg(r.shown, '|' ORDER BY score DESC, r.shown), '') ranking FROM ent LEFT JOIN ranks r ON r.image_id = ent.image_id AND r.id = ent.id GROUP BY ent.image_id, ent.id"""
    found["display_map"] = GRAPHS + DISPLAY + "SELECT image_id, id, CASE WHEN alone THEN shown WHEN told_ok THEN phrase END display_text, alone OR told_ok usable, told_ok used_disambiguation, CASE WHEN told_ok THEN array_to_string(list_sort(refs), ',') ELSE '' END referenced_ids FROM shown_map"
    found["split_assignment"] = GRAPHS + ", h AS (SELECT image_id, row_number() OVER (ORDER BY md5('42|' || image_id), image_id) i, count(*) OVER () k FROM (SELECT DISTINCT image_id FROM ent)) SELECT image_id, CASE WHEN i <= floor(k * 0.8::DOUBLE) THEN 'train' WHEN i <= floor(k * 0.8::DOUBLE) + floor(k * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM h"
    events = "WITH x AS (SELECT user_id image_id, event_type s, lead(event_type) OVER w o, row_number() OVER w ord FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), rel AS (SELECT image_id, ord, s subject_id, o object_id FROM x WHERE o IS NOT NULL AND o <> s)"
    found["connected_neighbors"] = events + "SELECT image_id, subject_id id, object_id neighbour FROM rel WHERE ord % 4 = 3"
    found["neighbours_of_two_predicates"] = events + "SELECT image_id, object_id id, subject_id neighbour FROM rel WHERE ord % 4 = 3"
    found["has_entity"] = GRAPHS + "SELECT DISTINCT image_id, unnest([subject_id, object_id]) id FROM rel"
    found["shared_container"] = GRAPHS + """, two AS (SELECT DISTINCT a.image_id, a.subject_id x, a.object_id y, b.object_id z FROM flow a JOIN flow b ON a.image_id = b.image_id AND a.object_id = b.subject_id AND b.object_id <> a.subject_id
        WHERE NOT EXISTS (SELECT 1 FROM flow d WHERE d.image_id = a.image_id AND d.subject_id = a.subject_id AND d.object_id = b.object_id)), held AS (SELECT DISTINCT image_id, subject_id box, object_id id FROM holds)
      SELECT two.image_id, x || '>' || y || '>' || z AS path, min(p.box) AS container FROM two JOIN held p ON p.image_id = two.image_id AND p.id = x JOIN held q ON q.image_id = two.image_id AND q.id = y AND q.box = p.box JOIN held r ON r.image_id = two.image_id AND r.id = z AND r.box = p.box GROUP BY two.image_id, x, y, z"""
    pick = "{0} QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY md5('42|{1}|' || image_id || '|' || {2}), {3}) = 1"
    found["presence_sample"] = GRAPHS + pick.format("SELECT image_id, ord, id, text FROM ent WHERE norm_text <> ''", "presence", "ord", "ord")
    found["absence_sample"] = GRAPHS + """, np AS (SELECT key, arg_min(shown, (image_id, ord)) AS text FROM (SELECT *, lower(shown) key FROM ent) WHERE key <> '' GROUP BY key), o AS (SELECT *, row_number() OVER (ORDER BY key) - 1 place, count(*) OVER () k FROM np),
      s AS (SELECT DISTINCT image_id, ('0x' || substr(md5('42|absence|' || image_id), 1, 8))::BIGINT luck FROM ent) SELECT s.image_id, arg_min(o.text, (place - luck % k + k) % k) AS text FROM s, o WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.image_id = s.image_id AND e.norm_text = o.key) GROUP BY s.image_id"""
    found["successor_sample"] = GRAPHS + pick.format("SELECT * FROM (" + unique.format("subject_id", "object_id", "flow") + ")", "successor", "id", "id")
    found["containment_sample"] = GRAPHS + pick.format("SELECT image_id, neighbour container, id child FROM (" + unique.format("object_id", "subject_id", "holds") + ")", "containment", "id", "id")
    found["edge_label_sample"] = GRAPHS + pick.format("SELECT image_id, ord, subject_id, object_id, edge_text FROM rel WHERE edge_text <> '' AND NOT is_conflict", "edge_label", "ord", "ord")
    found["conflict_sample"] = GRAPHS + pick.format("SELECT image_id, ord, subject_id, object_id FROM rel WHERE is_conflict", "conflict", "ord", "ord")
    negative = "SELECT a.image_id, a.id subject_id, b.id object_id FROM ent a JOIN ent b ON a.image_id = b.image_id AND a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.image_id = a.image_id AND r.subject_id = a.id AND r.object_id = b.id AND r.predicate = 'flows_to')"
    found["negative_relation_sample"] = GRAPHS + pick.format(f"SELECT * FROM ({negative})", "negative flows_to", "subject_id || '|' || object_id", "subject_id, object_id")
    every = PATHS.replace("FROM flow", "FROM loose").replace("JOIN flow", "JOIN loose").replace(", walk AS", ", loose AS (SELECT * FROM rel WHERE NOT is_conflict), walk AS")
    near = "SELECT image_id, src, tgt, path, hops FROM walk QUALIFY row_number() OVER (PARTITION BY image_id, src, tgt ORDER BY hops, ords) = 1"
    found["multihop_pair_sample"] = GRAPHS + every + pick.format(f"SELECT image_id, src, tgt, array_to_string(path, '>') AS path, hops::BIGINT hops FROM ({near}) WHERE hops >= 2", "multihop", "src || '|' || tgt", "src, tgt")
    found["event_relations"] = events + "SELECT * FROM rel"
    found["edge_exists"] = events + "SELECT DISTINCT image_id, object_id subject_id, subject_id object_id FROM rel a WHERE EXISTS (SELECT 1 FROM rel b WHERE b.image_id = a.image_id AND b.subject_id = a.object_id AND b.object_id = a.subject_id)"
    found["hierarchy_children"] = "SELECT n_regionkey image_id, 'r' || n_regionkey id, 'n' || n_nationkey neighbour FROM nation UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"
    options = "chr(10) || ".join(f"'{'ABCD'[i]}. {p}' || " for i, p in enumerate(PHRASES)).removesuffix(" || ")
    found["prompts"] = f"SELECT o_orderkey sample_id, 'Question: Which one is ' || o_orderkey || '?' || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE chr(10) || chr(10) || 'Options:' || chr(10) || {options} END prompt FROM orders"
    quoted = lambda x: f"'\"' || {x} || '\"'"
    opts = ", ".join(f'["{"ABCD"[i]}", "{p}"]' for i, p in enumerate(PHRASES))
    body = "'{\"ans\": ' || " + quoted("gold") + " || ', \"opts\": [" + opts + "], \"q\": \"Which \\\"one\\\" is ' || sample_id || '?\"}'"
    metrics = lambda multi: f"""SELECT model, count(*) n,
          sum(CASE WHEN parse_action = 'abstained' THEN 0 ELSE units END) FILTER (closed AND parse_action <> 'invalid' AND NOT is_unanswerable) / count(*) FILTER (closed AND parse_action <> 'invalid' AND NOT is_unanswerable) / {UNITS} answerable_correct_rate,
          sum((parse_action = 'abstained')::INT) FILTER (closed AND parse_action <> 'invalid' AND NOT is_unanswerable) / count(*) FILTER (closed AND parse_action <> 'invalid' AND NOT is_unanswerable) answerable_false_abstain_rate,
          sum((parse_action = 'abstained')::INT) FILTER (closed AND parse_action <> 'invalid' AND is_unanswerable) / count(*) FILTER (closed AND parse_action <> 'invalid' AND is_unanswerable) unanswerable_correct_abstain_rate,
          sum((parse_action <> 'abstained')::INT) FILTER (closed AND parse_action <> 'invalid' AND is_unanswerable) / count(*) FILTER (closed AND parse_action <> 'invalid' AND is_unanswerable) unanswerable_hallucination_rate,
          sum((error IS NOT NULL OR parse_action = 'invalid')::INT) FILTER (error IS NOT NULL OR closed) / count(*) FILTER (error IS NOT NULL OR closed) invalid_response_rate,
          {multi} multihop_f1, sum(units) FILTER (error IS NULL AND answer_type = 'open') / count(units) FILTER (error IS NULL AND answer_type = 'open') / {UNITS} l3_open_score,
          coalesce(sum(prompt_tokens), 0)::BIGINT prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT completion_tokens"""  # noqa: E731
    rows = {
        "sample_keys": f"SELECT sample_id, model || '::' || sample_id || '::' || question_type || '::' || substr(md5({body}), 1, 8) AS key FROM r",
        "token_usage": "SELECT model, count(*) FILTER (prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL) counted, coalesce(sum(prompt_tokens), 0)::BIGINT prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT completion_tokens FROM r GROUP BY model",
        "parse_abstain": "SELECT sample_id, abstains FROM s1", "parse_stage1_single": "SELECT sample_id, letter1 letter FROM s3", "parse_stage2_substring": "SELECT sample_id, letter2 letter FROM s3", "parse_cascade": "SELECT sample_id, parse_action, letters, parse_stage FROM parsed",
        "score_single": "SELECT sample_id, correct FROM scored", "metrics_by_level": "SELECT model, level, count(*) n, sum(units)::BIGINT units FROM u WHERE units IS NOT NULL GROUP BY ALL",
        "metrics_by_qtype": "SELECT model, question_type, count(*) n, sum(units)::BIGINT units FROM u WHERE units IS NOT NULL GROUP BY ALL",
        "stage_counts": "SELECT model, parse_stage, count(*) n FROM u WHERE error IS NULL AND parse_stage IS NOT NULL GROUP BY ALL",
        "metrics_by_model": metrics("NULL::DOUBLE") + " FROM u GROUP BY model",
    }
    found |= {k: REPLIES + v for k, v in rows.items()}
    parsed = "SELECT sample_id, parse_action, array_to_string(letters, ',') letters, parse_stage FROM parsed"
    found["parse_multi"], found["parse_multi_fixed"] = MULTI + parsed, MULTI_FIXED + parsed
    found["score_multi_f1"] = MULTI + f", s AS (SELECT *, len(list_intersect(coalesce(letters, []), gold)) hits, len(coalesce(letters, [])) + len(gold) both_ FROM parsed) SELECT sample_id, (parse_action = 'selected' AND list_sort(letters) = list_sort(gold))::BIGINT correct, CASE WHEN parse_action = 'selected' AND hits > 0 THEN floor(hits * 2 * {UNITS} / both_) ELSE 0 END::BIGINT f1_units FROM s"
    # the same replies as ones to questions with several right options, beside the single ones
    multi = MULTI.replace("WITH r0", "r0m").replace("r0m AS (", ", r0m AS (").replace("FROM r0)", "FROM r0m)").replace("r0.k", "r0m.k").replace("FROM r0 LEFT", "FROM r0m LEFT").replace("parsed AS (", "parsed_m AS (")
    multi += """, sm AS (SELECT *, len(list_intersect(coalesce(letters, []), gold)) hits, len(coalesce(letters, [])) + len(gold) both_ FROM parsed_m),
      um AS (SELECT u.model, u.error, u.is_unanswerable, u.prompt_tokens, u.completion_tokens, sm.parse_action, 'multi_select' answer_type, u.error IS NULL closed,
        CASE WHEN u.error IS NULL THEN CASE WHEN sm.parse_action = 'selected' AND sm.hits > 0 THEN floor(sm.hits * 2 * """ + str(UNITS) + """ / sm.both_) ELSE 0 END::BIGINT END units FROM sm JOIN u USING (sample_id)),
      every AS (SELECT model, error, is_unanswerable, prompt_tokens, completion_tokens, parse_action, answer_type, closed, units FROM u UNION ALL SELECT model, error, is_unanswerable, prompt_tokens, completion_tokens, parse_action, answer_type, closed, units FROM um) """
    f1 = "answer_type = 'multi_select' AND closed AND parse_action <> 'invalid'"
    found["metrics_with_multi_select"] = REPLIES + multi + metrics(f"sum(units) FILTER ({f1}) / count(*) FILTER ({f1}) / {UNITS}") + " FROM every GROUP BY model"
    found["cache_last_wins"] = "SELECT user_id AS key, event_type AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
    found["pending_work"] = "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)"
    return found
