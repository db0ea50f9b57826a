"""DuckDB SQL for the queries that SQL can express."""

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CLASS = r"'[\x20\x09-\x0D]+'"

QUALITY = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, [x for x in regexp_split_to_array(text, {CLASS}) if x <> ''] as words,
             [x for x in string_split(text, chr(10)) if regexp_replace(x, {CLASS}, '', 'g') <> ''] as lines from d),
p as (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3),
v as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as win from p),
r as (select doc_id, win from v group by doc_id, win having count(*) > 1),
c as (select doc_id, count(distinct pos) as n from (select v.doc_id, unnest([v.i, v.i + 1, v.i + 2]) as pos from v join r on v.doc_id = r.doc_id and v.win = r.win) group by doc_id),
m as (select w.doc_id, len(words)::bigint as n_words, length(regexp_replace(text, {CLASS}, '', 'g'))::bigint as word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols, len(lines)::bigint as n_lines,
             (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
      from w left join c on w.doc_id = c.doc_id),
f as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end + case when 5 * n_symbols > n_words then 4 else 0 end
             + case when n_lines >= 4 and 2 * n_dup_lines > n_lines then 8 else 0 end + case when n_words > 0 and word_chars < 2 * n_words then 16 else 0 end
             + case when n_words > 0 and word_chars > 40 * n_words then 32 else 0 end)::bigint as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed from f
"""

LINES = f"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
x as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from l),
k as (select doc_id, line, pos, translate(trim(line, {SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from x),
b as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
j as (select k.doc_id, k.line, k.pos, b.key is not null as gone from k left join b on k.key = b.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""

#: Control strings of the chat template and of others; an escaped text has one more character for each place where one begins.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\"]


def escaped(x: str) -> str:
    return f"(length({x}) + " + " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in CONTROL) + ")"


CHAT = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|>') + {escaped("role")} + length('<|im_sep|>') + {escaped("text")} + length('<|im_end|>') + 1)::bigint as formatted_chars,
       (count(*) filter (where role = 'assistant'))::bigint as n_examples
from t group by conv_id
"""

SQL = {"op8_chat_format": CHAT, "op4_quality_rules": QUALITY, "op5_line_dedup": LINES}
