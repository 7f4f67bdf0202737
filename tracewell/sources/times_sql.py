"""The moment a time text denotes, as DuckDB SQL: the counterpart of problem 1's operator."""

from __future__ import annotations

_CLOCK = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?"
_ZONE = r"(Z|z|[A-Za-z]{3,4}|[+-][0-9]{2}(?::?[0-9]{2})?)?"
_DAY = r"([0-9]{1,2})"
#: kind, pattern, what its groups are
_FORMS = [
    ("iso", rf"^([0-9]{{4}})-{_DAY}-{_DAY}[Tt ]{_CLOCK} ?{_ZONE}(?:\[[^\]]*\])?$", "y mo d h mi s f z"),
    ("compact", rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})[Tt ]?([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})(?:[.,]([0-9]+))?{_ZONE}$", "y mo d h mi s f z"),
    ("slash", rf"^{_DAY}/{_DAY}/([0-9]{{4}}),? +{_CLOCK}(?: ?([AaPp])\.?[Mm]\.?)? ?{_ZONE}$", "a b y h mi s f half z"),
    ("dotted", rf"^{_DAY}\.{_DAY}\.([0-9]{{4}}),? +{_CLOCK} ?{_ZONE}$", "d mo y h mi s f z"),
    ("clf", rf"^{_DAY}/([A-Za-z]{{3}})/([0-9]{{4}}):{_CLOCK} ?{_ZONE}$", "d mo y h mi s f z"),
    ("mail", rf"^(?:[A-Za-z]{{3}}, *)?{_DAY} ([A-Za-z]{{3}}) ([0-9]{{4}}) {_CLOCK} ?{_ZONE}$", "d mo y h mi s f z"),
    ("ctime", rf"^[A-Za-z]{{3}} ([A-Za-z]{{3}}) +{_DAY} {_CLOCK} (?:{_ZONE} )?([0-9]{{4}})$", "mo d h mi s f z y"),
]
_ABBREVIATIONS = "MAP {'Z': 0, 'UTC': 0, 'GMT': 0, 'CET': 60, 'CEST': 120, 'EST': -300, 'EDT': -240, 'PST': -480, 'PDT': -420, 'JST': 540}"
_MONTHS = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"


def moments(raw: str, out: str) -> str:
    """CTEs ending in ``out(key, ms)`` for ``raw(key, agent, t)``; keys without a moment are absent."""
    parts = " UNION ALL BY NAME ".join(
        f"SELECT key, zone, ord, unnest(regexp_extract(t, '{p}', {names.split()})) FROM {out}_t WHERE regexp_matches(t, '{p}')" for _, p, names in _FORMS
    )
    return rf"""
  {out}_clk AS (SELECT agent, CASE WHEN trim(c.zone) IN (SELECT name FROM pg_timezone_names()) THEN trim(c.zone) ELSE 'UTC' END AS zone, CASE WHEN lower(trim(c.date_order)) = 'mdy' THEN 'mdy' ELSE 'dmy' END AS ord
    FROM (SELECT agent, min({{'zone': zone, 'date_order': date_order}}) AS c FROM agent_clocks WHERE agent IS NOT NULL GROUP BY agent)),
  {out}_t AS (SELECT DISTINCT key, trim(regexp_replace(t, '[\s\v\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')) AS t, coalesce(zone, 'UTC') AS zone, coalesce(ord, 'dmy') AS ord FROM {raw} LEFT JOIN {out}_clk USING (agent)),
  {out}_n AS (
    SELECT key, unnest([CASE WHEN length(t) <= 11 THEN v * 1000 END, v, v // 1000, v // 1000000]) AS ms FROM (SELECT key, t, t::HUGEINT AS v FROM {out}_t WHERE regexp_matches(t, '^[0-9]{{10,19}}$'))
    UNION ALL SELECT key, split_part(t, '.', 1)::HUGEINT * 1000 + rpad(substr(split_part(t, '.', 2), 1, 3), 3, '0')::HUGEINT FROM {out}_t WHERE regexp_matches(t, '^[0-9]{{9,11}}[.][0-9]+$')),
  {out}_p AS (SELECT key, zone, upper(coalesce(z, '')) AS z, y::INT AS y, coalesce(try_cast(m AS INT), list_position({_MONTHS}, lower(m))) AS m, coalesce(d, CASE WHEN ord = 'mdy' THEN b ELSE a END)::INT AS d,
      CASE WHEN coalesce(half, '') = '' THEN h::INT WHEN h::INT BETWEEN 1 AND 12 THEN h::INT % 12 + CASE lower(half) WHEN 'p' THEN 12 ELSE 0 END END AS h, mi::INT AS mi, coalesce(nullif(s, ''), '0')::INT AS s, rpad(substr(f, 1, 3), 3, '0')::INT AS f
    FROM (SELECT *, coalesce(mo, CASE WHEN ord = 'mdy' THEN a ELSE b END) AS m FROM ({parts}))),
  {out}_w AS (SELECT *, try_strptime(printf('%04d-%02d-%02d %02d:%02d:%02d', y, m, d, h, mi, s), '%Y-%m-%d %H:%M:%S') AS wall, CASE WHEN regexp_matches(z, '^[+-]')
      THEN (CASE z[1] WHEN '-' THEN -1 ELSE 1 END) * (z[2:3]::INT * 60 + coalesce(try_cast(replace(z, ':', '')[4:5] AS INT), 0)) ELSE {_ABBREVIATIONS}[z] END AS shift FROM {out}_p WHERE m IS NOT NULL AND h IS NOT NULL),
  {out}_l AS (SELECT *, timezone(zone, wall) AS late FROM {out}_w WHERE z = ''),
  {out}_e AS (
    SELECT key, epoch_ms(wall) - shift * 60000 + f AS ms FROM {out}_w WHERE z <> ''
    UNION ALL SELECT key, epoch_ms(CASE WHEN timezone(zone, late - INTERVAL 1 HOUR) = wall THEN late - INTERVAL 1 HOUR ELSE late END) + f FROM {out}_l),
  {out} AS (SELECT DISTINCT key, ms::BIGINT AS ms FROM (SELECT * FROM {out}_n UNION ALL SELECT * FROM {out}_e) WHERE ms >= 1577836800000 AND ms < 1924992000000)"""
