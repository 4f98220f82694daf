"""DuckDB SQL for how close two names are, and for filing by it: matching blocks as a recursive query.

The longest block that two texts have in common, first in the one and then in
the other, splits both; what is left of it and what is right of it are split in
turn until nothing is common. The ratio is twice the letters in blocks over the
letters of both texts, in the order of the texts.
"""

from __future__ import annotations

LEAST, MARGIN = 0.82, 0.04
_KEY = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]', '', 'g')"
_BLOCKS = """list_max(flatten([[{'n': n, 'i': -i} for n in range(1, length(x) - i + 2) if contains(y, x[i : i + n - 1])] for i in range(1, length(x) + 1)]))"""


def forms(step: str, source: str) -> str:
    """Step with (name, key, loose, tokens, lead) of the names of another step."""
    doubled = "key"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        doubled = f"regexp_replace({doubled}, '{c}+', '{c}', 'g')"
    return f"""{step} AS (SELECT *, coalesce(list_reduce(list_prepend('', tokens), lambda p, q: CASE WHEN length(q) > length(p) THEN q ELSE p END), '') AS lead FROM (
  SELECT name, key, {doubled} AS loose, tokens FROM (SELECT name, {_KEY.format('name')} AS key, list_filter(regexp_extract_all(lower(coalesce(name, '')), '[a-z0-9]+'), lambda w: length(w) > 1) AS tokens FROM (SELECT DISTINCT name FROM {source}) d) k) f)"""


def ratios(step: str, pairs: str) -> str:
    """Step with (a, b, r): the ratio of every distinct (a, b) of a query."""
    return f"""{step}_cut AS (SELECT a, b, a AS x, b AS y, 0 AS k FROM (SELECT DISTINCT a, b FROM ({pairs}) p) d
 UNION ALL
 SELECT a, b, CASE WHEN side = 0 THEN x[:i - 1] ELSE x[i + n:] END, CASE WHEN side = 0 THEN y[:j - 1] ELSE y[j + n:] END, CASE WHEN side = 0 THEN n ELSE 0 END
 FROM (SELECT a, b, x, y, best.n AS n, -best.i AS i, instr(y, x[-best.i : -best.i + best.n - 1]) AS j FROM (SELECT a, b, x, y, {_BLOCKS} AS best FROM {step}_cut WHERE x <> '' AND y <> '') w WHERE best IS NOT NULL) m, (VALUES (0), (1)) s(side)),
{step} AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * sum(k) / (length(a) + length(b)) END::DOUBLE AS r FROM {step}_cut GROUP BY a, b)"""


def scores(asked: str) -> list[str]:
    """Steps up to likeness (l, r, score), for the pairs (l, r) of step ``asked``; needs steps left_forms and right_forms."""
    same = "(r >= 0.8 OR (x IN ('st', 'ste') AND starts_with(y, 'saint')) OR (y IN ('st', 'ste') AND starts_with(x, 'saint')))"
    return [
        f"""sides AS (SELECT p.l, p.r, a.key AS ka, b.key AS kb, a.loose AS la, b.loose AS lb, a.tokens AS ta, b.tokens AS tb, a.lead AS sa, b.lead AS sb
 FROM {asked} p JOIN left_forms a ON a.name = p.l JOIN right_forms b ON b.name = p.r)""",
        ratios("text_ratio", "SELECT ka AS a, kb AS b FROM sides WHERE ka <> kb UNION ALL SELECT la, lb FROM sides WHERE ka <> kb"),
        "words AS (SELECT DISTINCT ta, tb, unnest(ta) AS x, tb AS rest FROM sides WHERE ka <> kb)",
        "crossed AS (SELECT ta, tb, x, unnest(rest) AS y FROM words)",
        ratios("word_ratio", "SELECT x AS a, y AS b FROM crossed UNION ALL SELECT y, x FROM crossed UNION ALL SELECT sa, sb FROM sides WHERE ka <> kb"),
        f"""cells AS (SELECT ta, tb, x, y, f.r AS fr, g.r AS gr, {same.replace('r >=', 'f.r >=')} AS fs, {same.replace('r >=', 'g.r >=')} AS gs
 FROM crossed JOIN word_ratio f ON f.a = x AND f.b = y JOIN word_ratio g ON g.a = y AND g.b = x)""",
        # A repeated token counts once for each place: words are joined back to the places of the list.
        "ones AS (SELECT ta, tb, x, max(fr) AS best, bool_or(fs) AS met FROM cells GROUP BY ta, tb, x)",
        "twos AS (SELECT ta, tb, y, max(gr) AS best, bool_or(gs) AS met FROM cells GROUP BY ta, tb, y)",
        "ones_all AS (SELECT o.ta, o.tb, avg(best) AS mean, bool_and(met) AS met FROM (SELECT DISTINCT ta, tb, unnest(ta) AS x, generate_subscripts(ta, 1) AS at FROM sides) p JOIN ones o ON o.ta = p.ta AND o.tb = p.tb AND o.x = p.x GROUP BY o.ta, o.tb)",
        "twos_all AS (SELECT o.ta, o.tb, avg(best) AS mean, bool_and(met) AS met FROM (SELECT DISTINCT ta, tb, unnest(tb) AS y, generate_subscripts(tb, 1) AS at FROM sides) p JOIN twos o ON o.ta = p.ta AND o.tb = p.tb AND o.y = p.y GROUP BY o.ta, o.tb)",
        """likeness AS (SELECT l, r, CASE WHEN ka = '' OR kb = '' THEN 0.0 WHEN ka = kb THEN 1.0 WHEN loose >= 0.95 THEN loose WHEN len(ta) = 0 OR len(tb) = 0 THEN whole
  WHEN lead < 0.8 THEN greatest(lead * 0.5, inside) ELSE greatest(whole, spread, loose, inside) END::DOUBLE AS score FROM (
 SELECT p.*, w.r AS whole, c.r AS loose, s.r AS lead, (o.mean + t.mean) / 2 AS spread,
  CASE WHEN len(p.ta) <= len(p.tb) THEN CASE WHEN o.met THEN least(1.0, 0.86 + 0.07 * len(p.ta)) ELSE 0 END WHEN t.met THEN least(1.0, 0.86 + 0.07 * len(p.tb)) ELSE 0 END AS inside
 FROM sides p LEFT JOIN text_ratio w ON w.a = ka AND w.b = kb LEFT JOIN text_ratio c ON c.a = la AND c.b = lb LEFT JOIN word_ratio s ON s.a = sa AND s.b = sb
 LEFT JOIN ones_all o ON o.ta = p.ta AND o.tb = p.tb LEFT JOIN twos_all t ON t.ta = p.ta AND t.tb = p.tb) z)""",
    ]


#: Sheet names of the linking queries, from clients.
SHEET_NAMES = """sheet_names AS (SELECT id, CASE id % 4 WHEN 0 THEN lower(name) WHEN 1 THEN regexp_replace(name, '^(.)(.)', '\\1\\2\\2') WHEN 2 THEN regexp_replace(name, '^(...).', '\\1')
  ELSE concat_ws(' ', trim(regexp_replace(name, '^[^,]*,', '')), split_part(name, ',', 1)) END AS sheet_name FROM clients)"""

_SET_UP = " OR ".join(["coalesce(prefer_mail, false)", "mow_price IS NOT NULL", "hedge_price IS NOT NULL", *(f"coalesce(trim({c}), '') <> ''" for c in ("address", "email", "phone", "billing_notes"))])
PEOPLE = f"""people AS (SELECT id, name, {_KEY.format('name')} AS key, row_number() OVER (ORDER BY sort_order NULLS LAST, name, id) AS rank, mow_price IS NOT NULL OR hedge_price IS NOT NULL AS priced,
 ({_SET_UP}) AS set_up, coalesce(NOT on_roster, false) AS off FROM clients)"""


def candidates(step: str, left: str, right: str) -> list[str]:
    """Steps up to ``step`` (l, r): pairs of names of two steps that can score enough, with steps left_forms and right_forms."""
    shape = "3 * length(t) >= 2 * length(u) AND 3 * length(u) >= 2 * length(t) AND len(list_intersect(string_split(t, ''), string_split(u, ''))) * 10 >= least(length(t), length(u))"
    saint = "(t IN ('st', 'ste') AND starts_with(u, 'saint')) OR (u IN ('st', 'ste') AND starts_with(t, 'saint'))"
    return [
        forms("left_forms", left),
        forms("right_forms", right),
        "left_words AS (SELECT DISTINCT name, lead, unnest(tokens) AS t FROM left_forms)",
        "right_words AS (SELECT DISTINCT name, lead, unnest(tokens) AS u FROM right_forms)",
        f"""met AS (SELECT t, u FROM (SELECT t, bool_or(t = lead) AS tl FROM left_words GROUP BY t) a, (SELECT u, bool_or(u = lead) AS ul FROM right_words GROUP BY u) b WHERE (tl OR ul) AND ({shape} OR {saint}))""",
        ratios("met_ratio", "SELECT t AS a, u AS b FROM met UNION ALL SELECT u, t FROM met"),
        f"alike AS (SELECT t, u FROM met LEFT JOIN met_ratio f ON f.a = t AND f.b = u LEFT JOIN met_ratio g ON g.a = u AND g.b = t WHERE f.r >= 0.8 OR g.r >= 0.8 OR {saint})",
        f"""{step} AS (SELECT l.name AS l, r.name AS r FROM left_words l JOIN alike x ON x.t = l.t JOIN right_words r ON r.u = x.u WHERE l.t = l.lead OR r.u = r.lead
 UNION SELECT l.name, r.name FROM left_forms l JOIN right_forms r ON (substr(l.loose, 1, 3) = substr(r.loose, 1, 3) OR l.loose[-3:] = r.loose[-3:]) AND abs(length(l.loose) - length(r.loose)) <= 2
 UNION SELECT l.name, r.name FROM left_forms l JOIN right_forms r ON len(l.tokens) = 0 OR len(r.tokens) = 0)""",
    ]


def best(step: str, rows: str) -> str:
    """Step (sheet_name, best, tied) from rows (sheet_name, id, rank, score) of a query."""
    return f"""{step} AS (SELECT sheet_name, arg_min(id, n) AS best, coalesce(max(score) FILTER (n = 2) > max(score) - {MARGIN}, false) AS tied FROM (
  SELECT *, row_number() OVER (PARTITION BY sheet_name ORDER BY score DESC, rank) AS n FROM ({rows}) s WHERE score >= {LEAST}) o WHERE n <= 2 GROUP BY sheet_name)"""


def ladder(names: str, roster: str = "clients") -> list[str]:
    """Steps people, exact and asked: each distinct sheet_name with the clients of its key."""
    first = lambda when: f"arg_min(id, rank) FILTER ({when})"
    return [
        PEOPLE.replace("FROM clients", f"FROM {roster}"),
        f"exact AS (SELECT key, {first('priced')} AS priced, {first('off')} AS off, {first('set_up')} AS set_up, {first('NOT set_up')} AS unset, {first('true')} AS one FROM people WHERE key <> '' GROUP BY key)",
        f"asked AS (SELECT a.sheet_name, a.key, e.* EXCLUDE (key) FROM (SELECT DISTINCT sheet_name, {_KEY.format('sheet_name')} AS key FROM {names} WHERE sheet_name IS NOT NULL) a LEFT JOIN exact e USING (key))",
    ]


_FILED_ROWS = "SELECT l AS sheet_name, p.id, p.rank, score FROM likeness JOIN people p ON p.name = r AND p.set_up JOIN asked a ON a.sheet_name = l WHERE a.key <> p.key"
_FILED = """filed AS (SELECT a.sheet_name, coalesce(priced, off, CASE WHEN best IS NULL THEN coalesce(set_up, unset, one) WHEN tied THEN coalesce(set_up, unset) ELSE best END) AS client_id FROM asked a LEFT JOIN clear c ON c.sheet_name = a.sheet_name)"""
_NEAR_ROWS = f"SELECT l AS sheet_name, p.id, p.rank, score FROM likeness JOIN people p ON p.name = r WHERE p.key <> {_KEY.format('l')}"


def filing(names: str, roster: str = "clients") -> list[str]:
    """Steps up to filed (sheet_name, client_id) for the sheet_name of a step, among the rows of the roster step."""
    return [
        *ladder(names, roster),
        "unsure AS (SELECT sheet_name AS name FROM asked WHERE coalesce(priced, off) IS NULL)",
        "set_people AS (SELECT name FROM people WHERE set_up AND trim(name) <> '')",
        *candidates("pairs", "unsure", "set_people"),
        *scores("pairs"),
        best("clear", _FILED_ROWS),
        _FILED,
    ]


def conflicts(rows: str) -> list[str]:
    """Steps up to conflicts for a step with seq, sheet_name and work, whose work is the same in all rows of a key; needs clients."""
    return [
        *ladder(rows),
        f"named AS (SELECT DISTINCT sheet_name AS name FROM {rows} WHERE sheet_name IS NOT NULL)",
        "all_people AS (SELECT name FROM people WHERE trim(name) <> '')",
        *candidates("pairs", "named", "all_people"),
        *scores("pairs"),
        best("clear", _FILED_ROWS),
        _FILED,
        best("near", _NEAR_ROWS),
        f"""still AS (SELECT {_KEY.format('r.sheet_name')} AS key, min(seq) AS seq, arg_min(r.sheet_name, seq) AS name, min(work) AS work FROM {rows} r JOIN filed f ON f.sheet_name = r.sheet_name WHERE client_id IS NULL AND {_KEY.format('r.sheet_name')} <> '' GROUP BY 1)""",
        "conflicts AS (SELECT s.key, s.seq, s.name, s.work, p.id AS suggestion, p.name AS suggestion_name FROM still s LEFT JOIN near n ON n.sheet_name = s.name AND NOT n.tied LEFT JOIN people p ON p.id = n.best)",
    ]


def suggestions(names: str) -> list[str]:
    """Steps up to suggested (sheet_name, suggestion, suggestion_name); needs clients."""
    return [
        PEOPLE,
        f"named AS (SELECT DISTINCT sheet_name AS name FROM {names} WHERE sheet_name IS NOT NULL)",
        "all_people AS (SELECT name FROM people WHERE trim(name) <> '')",
        *candidates("pairs", "named", "all_people"),
        *scores("pairs"),
        best("clear", _NEAR_ROWS),
        "suggested AS (SELECT sheet_name, best AS suggestion, name AS suggestion_name FROM clear JOIN people ON people.id = best WHERE NOT tied)",
    ]
