"""DuckDB SQL of the numbered queries that SQL can state: licences, WARC records, fingerprints, repaired and formatted conversations, resampling."""

from __future__ import annotations

from .chat import ADDED, CONTROL
from .licenses import HELD, HOLDER, NOTICE, OPENING, RIGHTS, SHORT, SPELLINGS, TELLING, known_rows
from .resampling import BETWEEN, LOWER, UPPER
from .spotsigs import ALIKE, ANCHORS, COMMON


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "(" + ", ".join(map(_text, xs)) + ")"


def _spelled(padded: str) -> str:
    for a, b in SPELLINGS:
        for _ in range(2):
            padded = f"replace({padded}, ' {a} ', ' {b} ')"
    return f"trim({padded})"


def _plain(x: str) -> str:
    return _spelled(rf"' ' || regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' '")


def licenses() -> str:
    rows = known_rows()
    known = ", ".join(f"({_text(d)}, {_text(n)})" for d, n in sorted({r[:2] for r in rows}))
    openings: dict[str, set[int]] = {}
    for _, _, n, o in rows:
        if o:
            openings.setdefault(o, set()).add(n)
    opened = ", ".join(f"({_text(o)}, {sorted(n)})" for o, n in sorted(openings.items()))
    lengths = sorted({r[2] for r in rows})
    change = 2 * max(len(b) - len(a) for a, b in SPELLINGS) + 8
    return rf"""
with known(digest, license) as (values {known}), opened(opening, lengths) as (values {opened}),
base as (select row_number() over () as k, doc_id, coalesce(text, '') as t, string_split_regex(lower(coalesce(text, '')), '\r\n|\n|\r') as lines from documents),
flat as (select k, doc_id, lines, string_split_regex(regexp_replace(regexp_replace(lower(t), '[ \t\n\x0B\f\r]+', ' ', 'g'), {_text(SHORT)}, '\1\2', 'g'), {_text(NOTICE)}) as pieces from base),
cuts as (select k, doc_id, lines, pieces[1] || ' ' || array_to_string(list_transform(pieces[2:], lambda x: case when regexp_matches(x, {_text(HELD)}) then regexp_replace(x, {_text(HELD)}, '\1') when length(x) <= {HOLDER} then '' else x end), ' ') as held from flat),
formed as (select k, doc_id, lines, replace(held, {_text(RIGHTS)}, ' ') as kept from cuts),
form as (select k, doc_id, lines, {_plain('kept')} as form from formed),
lined as (select distinct k, unnest(list_filter(lines, lambda x: length(x) >= {min(lengths) - change} and regexp_matches(x, {_text(TELLING)}))) as line from form),
plained as (select k, {_plain('line')} as line from lined),
line_hits as (select k, string_agg(distinct license, ',' order by license) as line_licenses from plained join known on known.digest = sha256(line) where length(line) in {tuple(lengths)} group by 1),
split as (select k, form, lengths, string_split(form, opening) as parts from form, opened where contains(form, opening)),
starts as (select k, form, lengths, parts, unnest(range(1, len(parts))) as i from split),
blocks as (select k, form, unnest(lengths) as n, 1 + coalesce(list_sum(list_transform(parts[1:i], lambda p: length(p))), 0) + (i - 1) * {OPENING} as pos from starts),
block_hits as (select k, string_agg(distinct license, ',' order by license) as block_licenses from blocks join known on known.digest = sha256(substr(form, cast(pos as bigint), n)) where pos + n - 1 <= length(form) group by 1)
select doc_id, sha256(form) as text_digest, known.license, coalesce(line_licenses, '') as line_licenses, coalesce(block_licenses, '') as block_licenses
from form left join known on known.digest = sha256(form) left join line_hits on line_hits.k = form.k left join block_hits on block_hits.k = form.k"""


WARC = """
with p as (select page_id, coalesce(html, '') as t from pages), f as (select t, min(page_id) as first from p group by 1)
select p.page_id, cast(octet_length(encode(p.t)) as bigint) as payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(sha1(p.t), cast((i // 4) * 5 + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint) + 1, 1)), '') as payload_digest,
case when p.page_id = f.first then 'response' else 'revisit' end as record_type, case when p.page_id <> f.first then f.first end as refers_to
from p join f on f.t = p.t"""


def _signatures(t: str) -> str:
    glued = rf"array_to_string(list_transform(string_split_regex(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: case when x = '' or x in {_list(COMMON)} then '' when x in {_list(ANCHORS)} then x || chr(1) else x || ' ' end), '')"
    return f"list_filter(string_split({glued}, ' '), lambda w: w <> '')"


def fingerprints() -> str:
    hashed = "cast('0x' || substr(md5(w[i] || ' ' || coalesce(string_split(w[i + 1], chr(1))[-1], '')), 1, 8) as bigint)"
    every = "range(1, len({w}) + 1)"
    sigs = lambda w: (
        f"list_sort(list_distinct(list_transform(list_filter({every}, lambda i: contains({{w}}[i], chr(1)) or not {{w}}_any), lambda i: {hashed.replace('w[', '{w}[')})))".replace("{w}", w)
    )
    like = lambda a, b: f"case when len({a}) + len({b}) = 0 then 1.0::double else len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::double end"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, t, coalesce(lead(t) over (order by doc_id, t), first_value(t) over (order by doc_id, t)) as nt from d),
e as (select *, substr(t, 1, length(t) - length(t) // 4) || substr(nt, 1, length(t) // 4) as edited from n),
w as (select *, {_signatures('t')} as a, {_signatures('edited')} as b, {_signatures('nt')} as c from e),
f as (select *, len(list_filter(a, lambda x: contains(x, chr(1)))) > 0 as a_any, len(list_filter(b, lambda x: contains(x, chr(1)))) > 0 as b_any, len(list_filter(c, lambda x: contains(x, chr(1)))) > 0 as c_any from w),
s as (select *, {sigs('a')} as sa, {sigs('b')} as sb, {sigs('c')} as sc from f),
l as (select *, {like('sa', 'sb')} as near_edited, {like('sa', 'sc')} as near_next from s)
select doc_id, length(t) as n_chars, sha256(edited) as edited_sha256, array_to_string(sa, ',') as fingerprint, array_to_string(sb, ',') as edited_fingerprint, near_edited, near_next, near_edited >= {ALIKE} as edited_alike, near_next >= {ALIKE} as next_alike from l"""


#: CRC-32 by its rule: the table of 256 entries, and the running value over a string's bytes.
_CRC_TABLE = "crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)::bigint[]), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as entries)"


def _crc32(x: str) -> str:
    """The CRC-32 of a string, where the table's row stands beside it."""
    octets = f"list_transform(range(octet_length(encode({x}))), lambda i: cast('0x' || substr(hex(encode({x})), 2 * i + 1, 2) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295)"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda w: w <> '')"


def resampling(percent: int = 10, least_words: int = 20, buckets: int = 10_000, seed: int = 2024) -> str:
    return f"""
with {_CRC_TABLE},
d as (select row_number() over () as k, doc_id, {_words('text')} as ws from documents),
b as (select {_words('text')} as ws from benchmark),
own as (select k, unnest(ws) as w from d), target as (select unnest(ws) as w from b),
known as (select w, {_crc32('w')} % {buckets} as bucket from (select distinct w from (select w from own union all select w from target)), crc),
s as (select bucket, count(*) as n from own join known using (w) group by 1), t as (select bucket, count(*) as n from target join known using (w) group by 1),
gain as (select i as bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + {buckets})::double / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + {buckets})::double))) as bigint) as gain
  from range({buckets}) r(i) left join s on s.bucket = i left join t on t.bucket = i),
sums as (select k, count(*) as n, cast(sum(gain) as bigint) as total from own join known using (w) join gain using (bucket) group by 1),
weighed as (select d.k, doc_id, len(ws) as n_words, coalesce(n, 0) as n_features, coalesce(cast((total - ((total % n) + n) % n) / n as bigint), 0) as weight, cast('0x' || substr(sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h
  from d left join sums on sums.k = d.k),
scored as (select k, doc_id, n_words, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from weighed),
ranked as (select k, row_number() over (order by score desc, doc_id nulls first) as rank, count(*) over () as n from scored where n_words >= {least_words})
select doc_id, cast(n_features as bigint) as n_features, weight, score, case when rank <= {percent} * n // 100 then rank end as rank from scored left join ranked using (k)"""


def _step(x: str, cost: str, letter: str, row: str | None) -> str:
    kept = f"list_append({x}.t, {row})" if row else f"{x}.t"
    return f"case when {x} is not null then {{'k': lpad(cast(cast(substr({x}.k, 1, 12) as bigint) + {cost} as varchar), 12, '0') || substr({x}.k, 13) || '{letter}', 't': {kept}}} end"


def _best(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o is not null))[1]"


#: The least cost and audit of every state by a plain forward walk, row by row.
def repair() -> str:
    user, assistant = "'user:'", "'assistant:'"
    inserts = lambda u: (_best(u, *(_step(x, "5", "I", user) for x in "esa")), lambda now: _best("a", _step(now, "5", "I", assistant)))
    to_user, to_assistant = inserts("u")
    delete = lambda x: _step(x, "2", "D", None)
    keep = lambda x, initial: f"case when not gone and initial = '{initial}' then {_step(x, 'extra', 'K', 'shown')} end"
    rerole = lambda x, role: f"case when not gone then {_step(x, '1 + extra', 'R', role)} end"
    as_user, as_assistant = "'user:' || text", "'assistant:' || text"
    return rf"""
with recursive {_CRC_TABLE},
shown as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
kinds as (select *, {_crc32('key')} % 20 as kind from shown, crc),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy from kinds where kind <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i, substr(role, 1, 1) as initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as trimmed from damaged),
seen as (select *, trimmed = '' as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again, lag(initial) over (partition by conv_id order by i) as before from numbered),
faults as (select *, trimmed <> '' and again as duplicate, trimmed <> '' and not again and right(trimmed, 1) not in ('.', '!', '?') as cut from seen),
rows as (select conv_id, i, initial, text, role || ':' || text as shown, blank or duplicate as gone, case when cut then 5 else 0 end as extra from faults),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (cut) as truncated,
  count(*) filter (i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal, max(i) as n from faults group by 1),
walk as (
  select conv_id, 0::bigint as i, {{'k': '000000000000', 't': []::varchar[]}} as e, null::struct(k varchar, t varchar[]) as s, null::struct(k varchar, t varchar[]) as u, null::struct(k varchar, t varchar[]) as a from (select distinct conv_id from conversations)
  union all
  select conv_id, i, {delete('e')} as e, {_best(delete('s'), keep('e', 's'))} as s,
    {_best(delete('u'), *(keep(x, 'u') for x in 'esa'), *(rerole(x, as_user) for x in 'esa'))} as u, {_best(delete('a'), keep('u', 'a'), rerole('u', as_assistant))} as a
  from (
    select rows.conv_id, rows.i, initial, text, shown, gone, extra, e, s, u, {to_assistant('u')} as a
    from (select conv_id, i, e, s, a, {to_user} as u from walk) as w join rows on rows.conv_id is not distinct from w.conv_id and rows.i = w.i + 1)),
ends as (select conv_id, i, e, u, {to_assistant('u')} as a from (select conv_id, i, e, a, {to_user} as u from walk)),
done as (select conv_id, i, {_best('e', 'a')} as best from ends)
select done.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
cast(substr(best.k, 1, 12) as bigint) as cost, substr(best.k, 13) as audit, sha256(array_to_string(best.t, chr(10))) as repaired_sha256
from done left join counted on counted.conv_id is not distinct from done.conv_id where done.i = coalesce(counted.n, 0)"""


def chats() -> str:
    role = r"replace(replace(replace(role, '\', '\\'), '|', '\!'), chr(10), '\n')"
    return rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-1, 0, 'user', {_text(ADDED)}), (-1, 1, 'assistant', {_text(ADDED)})),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, length({role}) + length(regexp_replace(text, {_text(CONTROL)}, '\1\\\2\3', 'g')) + 10 as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
from n group by 1"""
