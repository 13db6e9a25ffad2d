"""SQL for the operators that SQL can express, over the same whole tables."""

from __future__ import annotations

from .chat import END

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATE = f"""
with dw as materialized (select doc_id, {_words("text")} w from documents), iw as (select item_id, {_words("text")} w from benchmark),
it as (select item_id, w, least(len(w), 10) n from iw where len(w) > 0),
win as materialized (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') t from (select *, unnest(range(1, len(w) - n + 2)) i from it)),
scan as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') t from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, (select distinct n from win) where len(w) >= n)),
hits as materialized (select doc_id, i, scan.n n, item_id from scan join win on scan.t = win.t and scan.n = win.n),
hit as (select doc_id, count(distinct p) c from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
named as (select doc_id, count(*) c, string_agg(s, ',' order by s) ids from (select distinct doc_id, item_id::varchar s from hits) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(hit.c, 0)::bigint n_hit, coalesce(named.c, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(hit.c, 0) > 0 contaminated
from dw left join hit using (doc_id) left join named using (doc_id)"""

LINES = f"""
with ln as materialized (select doc_id, generate_subscripts(l, 1) i, unnest(l) line from (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents)),
k as materialized (select *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') key from ln),
hot as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint n_lines, count(hot.key)::bigint n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (hot.key is null), '')) kept_sha256
from k left join hot using (key) group by doc_id"""


def _escaped(text: str) -> str:
    return rf"replace(replace(replace({text}, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ')"


CHAT = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f as (select *, 4 + length(replace({_escaped("role")}, ':', '\:')) + 2 + length({_escaped("text")}) + {len(END)} size from t),
e as (select *, sum(size) over w ends, row_number() over w = count(*) over (partition by conv_id) last from f window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
    (coalesce(sum(ends) filter (role = 'assistant'), 0) + coalesce(sum(ends) filter (last and role <> 'assistant'), 0))::bigint formatted_chars
from e group by conv_id"""

RULES = rf"""
with d as materialized (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as materialized (select doc_id, i, array_to_string(w[i : i + 7], ' ') t from (select doc_id, w, unnest(range(1, len(w) - 6)) i from d)),
twice as (select doc_id, t from win group by doc_id, t having count(*) > 1),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 8)) p from win join twice using (doc_id, t)) group by doc_id),
ln as (select doc_id, count(*) n, count(*) - count(distinct line) dup from (select doc_id, unnest(string_split(text, chr(10))) line from d) where trim(line, {BLANKS}) <> '' group by doc_id),
m as (select doc_id, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
    coalesce(ln.n, 0) n_lines, coalesce(ln.dup, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) n_same, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) n_upper
    from d left join ln using (doc_id) left join rep using (doc_id)),
b as (select *, (n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint + 4 * (10 * n_symbols > n_words)::bigint + 8 * (word_chars < 2 * n_words or word_chars > 15 * n_words)::bigint
    + 16 * (n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines)::bigint + 32 * (100 * n_same > 20 * n_words)::bigint + 64 * (100 * n_upper > 50 * n_letters)::bigint failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 base_failed, failed = 0 kept, failed from b"""

def _grams(n: int) -> str:
    return f"select lang, {n} size, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) phrase from p"


PHRASES = rf"""
with p as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from (select coalesce(lang, 'und') lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) piece from documents)),
f as materialized (select lang, size, phrase, count(*)::hugeint a, string_split(phrase, ' ') w from ({" union all ".join(map(_grams, range(1, 5)))}) group by all having count(*) >= 30),
cut as (select lang, phrase, a, k, array_to_string(w[1 : k], ' ') x, array_to_string(w[k + 1 :], ' ') y from (select *, unnest(range(1, size)) k from f)),
scored as (select cut.lang, cut.phrase, cut.a, k, x.a l, y.a r, (2000000 * cut.a) // (x.a + y.a) score from cut join f x on x.lang = cut.lang and x.phrase = cut.x join f y on y.lang = cut.lang and y.phrase = cut.y
    qualify row_number() over (partition by cut.lang, cut.phrase order by score, k) = 1),
part as (select lang, a, size, w, s, unnest(range(1, size - s + 2)) pos from (select *, unnest(range(2, size)) s from f where size > 2)),
cover as (select lang, array_to_string(w[pos : pos + s - 1], ' ') phrase, max(a) longer from part group by all),
words as (select lang, sum(len(w)) n from p group by lang)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score
from scored left join cover using (lang, phrase) join words using (lang) where longer is null or 100 * longer < 80 * a qualify rank <= 2000"""

def _crc(start: str, byte: str) -> str:
    """One byte of a CRC-32, bit by bit."""
    return f"list_reduce([xor({start}, {byte}), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"


TRIE = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
a as materialized (select conv_id, list(sha256(strlen(role) || ':' || role || text) order by turn nulls first, role, text) keys, list(strlen(text) order by turn nulls first, role, text) sizes from t group by conv_id),
h as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda x, c: {_crc("x", "c")}), 4294967295) % 9 h from a),
r as materialized (select h.conv_id, list_concat(coalesce(b.keys, [])[1 : h], h.keys[h + 1 :]) keys, list_concat(coalesce(b.sizes, [])[1 : h], h.sizes[h + 1 :]) sizes from h left join a b on b.conv_id = h.conv_id - h.conv_id % 5),
d as materialized (select conv_id, d, array_to_string(keys[1 : d], '') k, array_to_string(keys[1 : d - 1], '') up, coalesce(sizes[d], 0) size, d = len(keys) ends from (select *, unnest(range(0, len(keys) + 1)) d from r)),
n as materialized (select k, any_value(up) up, d, min(conv_id) conv_id, count(*) n_convs, any_value(size) size, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) ends_sha256 from d group by k, d),
c as (select up, d - 1 d, count(*) n from n where d > 0 group by all),
s as (select n.*, coalesce(c.n, 0) n_children from n left join c on c.up = n.k and c.d = n.d),
above as (select left(k, (64 * e)::bigint) k, e d, count(*) filter (n_children = 0) n_leaves, sum((n_convs - 1) * size) saved from (select *, unnest(range(0, d + 1)) e from s) group by all)
select s.conv_id, s.d::bigint depth, p.conv_id parent_conv_id, s.n_convs, s.n_children, above.n_leaves, above.saved::bigint saved_tokens, s.ends_sha256
from s join above on above.k = s.k and above.d = s.d left join s p on p.k = s.up and p.d = s.d - 1"""

ORACLE_SQL = {"op3_decontaminate": DECONTAMINATE, "op8_lines": LINES, "op9_chat": CHAT, "op10_rules": RULES, "op12_phrases": PHRASES, "op13_turn_trie": TRIE}
