"""The same results in DuckDB SQL, written as directly as possible."""

from __future__ import annotations

from glossa.fixtures import QDOC, QSET

NEEDLES = ("the", "LA", "über", "é", "tion")


def fold(x: str) -> str:
    return f"translate({x},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"


WS = r"[ \t\n\r\f]+"
TOKEN = r"([0-9A-Za-z\x00-\x08\x0B\x0E-\x1F\x7F][A-Za-z\x00-\x08\x0B\x0E-\x1F\x7F]*[0-9])"
UNI = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}'), lambda w: w <> '')"


def literal(rows) -> str:
    return ", ".join("({}, '{}', {})".format(i, q.replace("'", "''"), k) for i, q, k in rows)


LEX = """lex as (
  select p_partkey entry_key,
       translate(substring(p_brand,6),'#0123456789','品零一二三四五六七八九') headword,
       array_to_string(list_transform(string_split(p_name,' '), lambda w,i: w||cast((p_size+i)%6+1 as varchar)),' ') reading,
       [p_name,p_type,p_brand] definitions, p_size*100 static_cost,
       if(p_partkey%2=0,'A','B') source
  from part)"""
LDOC = """ldoc as (
  select doc_id entry_key, list_filter(list_transform(string_split(text,chr(10)), lambda x: trim(x)), lambda x: x<>'') definitions,
       cast(n_chars as int) static_cost, lang source from documents)"""
QS = f"""qset as (
  select cast(c0 as bigint) query_id, c1 query, c2 k from (values {literal(QSET)}) t(c0, c1, c2)
  union all
  select min(p_partkey)+1000, p_name, 12 from part group by p_name)"""
QD = f"qset as (select cast(c0 as bigint) query_id, c1 query, c2 k from (values {literal(QDOC)}) t(c0, c1, c2))"
CFREQ = r"""ck as (select ch, count(*) cnt from (select unnest(string_split(text,'')) ch from documents)
                   where regexp_matches(ch,'[^\x00-\x20]') group by ch),
  cr as (select row_number() over (order by cnt desc, ch) idx, ch, cnt,
                sum(cnt) over (order by cnt desc, ch rows unbounded preceding) rc, sum(cnt) over () tot from ck),
  cfreq as (select idx, ch, cnt, round(100.0::double*rc/tot,6) cum_pct from cr)"""
CCOST = (
    CFREQ
    + """,
  cf as (select idx, ch, cnt, ((cum_pct::float - coalesce(lag(cum_pct::float) over (order by idx), 0::float))::float / 100::float)::float f from cfreq),
  ccost as (select idx, ch, cnt, f, case when f < 0 then 0 when f = 0 then 7000
     else trunc(least(greatest((-1000)::float * ln(f::double)::float, 1::float), 7000::float))::bigint end cost from cf)"""
)
PART_TERMS = f"""pt as (select distinct word from (
   select unnest({words('p_name')}) word from part union all select unnest({words('p_type')}) from part
   union all select unnest({words('event_type')}) from events))"""
DVOCAB = f"dvocab as (select distinct unnest({words('text')}) word from documents)"

# Query terms and the entries they are matched with.
SEARCH_BASE = f"""
  toks as (select query_id, query, k, {words('query')} toks from qset),
  qt as (select query_id, query, k, len(toks) n_terms, unnest(toks) tok, generate_subscripts(toks,1)-1 idx from toks),
  qterm as (select *, {fold('tok')} tok_fold, regexp_replace(tok,'[0-9]$','') base, {fold("regexp_replace(tok,'[0-9]$','')")} base_fold,
            try_cast(nullif(regexp_extract(tok,'[0-9]$'),'') as int) tone from qt)"""


def edit_one(q: str, t: str) -> str:
    """One insert or delete away from a non-empty prefix."""
    return f"""(strlen({q}) = length({q}) and length({q}) > 0 and (
        (length({q}) >= 2 and length({t}) >= length({q})-1 and levenshtein({q}, left({t}, length({q})-1)) = 1)
        or (length({t}) >= length({q})+1 and strlen(left({t}, length({q})+1)) = length({q})+1 and levenshtein({q}, left({t}, length({q})+1)) = 1)))"""


def term_cost(q: str, qf: str, s: str) -> str:
    return f"""case when {q} = '' then null when {fold(s)} = {qf} then 0
       when strpos({fold(s)}, {qf}) > 0 then strlen(left({s}, strpos({fold(s)}, {qf})-1))*12000 + (strlen({s})-strlen({q}))*2500
       when {edit_one(q, s)} then 20000 end"""


def inversions(p: str) -> str:
    return (
        f"coalesce(list_sum(list_transform({p}, lambda x,i: len(list_filter({p}[i+1:], lambda y: x > y)))),0)*8000"
    )


SYLLABLE = f"""
  es as (select entry_key, static_cost, len(syl) n_syl, generate_subscripts(syl,1)-1 pos, unnest(syl) tok
         from (select entry_key, static_cost, regexp_extract_all(reading, '{TOKEN}', 1) syl from lex)),
  esyl as (select *, left(tok, length(tok)-1) base, right(tok,1)::int tone from es),
  tm as (select q.base term_base, v.base, {term_cost('q.base', 'q.base_fold', 'v.base')} match_cost
         from (select distinct base, base_fold from qterm) q cross join (select distinct base from esyl) v),
  best as (select q.query_id, q.idx, q.n_terms, e.entry_key, e.static_cost, e.n_syl, min(m.match_cost*2147483648 + e.pos) b
         from qterm q join tm m on m.term_base = q.base and m.match_cost is not null join esyl e on e.base = m.base
         where q.tone is null or q.tone = e.tone group by all),
  per as (select query_id, entry_key, static_cost, n_syl, n_terms, count(*) c, sum(b >> 31) term_cost,
                 list(b & 2147483647 order by idx) ps from best group by all),
  jm as (select query_id, entry_key entry_id, 'Jyutping' match_type, term_cost::bigint term_match_cost,
            ((n_syl*(n_syl+3))//2 - list_sum(list_transform(list_distinct(ps), lambda p: n_syl+1-p)))::bigint*10000 unmatched_position_cost,
            ({inversions('ps')})::bigint inversion_cost, static_cost::bigint static_cost
         from per where c = n_terms and n_syl >= n_terms)"""


def english(entries: str) -> str:
    return f"""
  eb as (select entry_key, static_cost, array_to_string(definitions,'') raw, {fold("array_to_string(definitions,'')")} block from {entries}),
  ep as (select q.query_id, q.query, q.n_terms, q.idx, e.entry_key, e.static_cost, e.block, strpos(e.block, q.tok_fold) p
         from qterm q cross join eb e where strlen(q.query) > 2),
  ec as (select *, strlen(left(block, p-1)) off,
            case when p = 1 or substring(block, p-1, 1) in (' ', chr(9), chr(10), chr(13), chr(12), '-') then 0 else 5000 end mid from ep where p > 0),
  eper as (select query_id, query, entry_key, static_cost, n_terms, count(*) c, sum(off*100+mid) s, list(off order by idx) ps from ec group by all),
  em as (select query_id, entry_key entry_id, 'English' match_type,
            (5000 + s + 8000*length(regexp_replace(query,'[\\x00-\\x7F]','','g')))::bigint term_match_cost, 0::bigint unmatched_position_cost,
            ({inversions('ps')})::bigint inversion_cost, static_cost::bigint static_cost from eper where c = n_terms)"""


HEADWORD = """
  hc as (select distinct unnest(string_split(headword,'')) ch from lex),
  qc as (select distinct query_id, unnest(string_split(query,'')) ch from qset),
  kc as (select query_id, list(ch) chars from qc semi join hc using (ch) group by query_id),
  tm_h as (select k.query_id, l.entry_key entry_id, 'Traditional' match_type, 0::bigint term_match_cost, 0::bigint unmatched_position_cost,
            0::bigint inversion_cost, l.static_cost::bigint static_cost
         from kc k cross join lex l where len(list_filter(k.chars, lambda c: not contains(l.headword, c))) = 0)"""

TOTAL = "term_match_cost + unmatched_position_cost + inversion_cost + static_cost as total_cost"
ALL = f"""allm as (select * from jm union all
     (select * from em anti join jm using (query_id, entry_id)) union all (select * from tm_h anti join jm using (query_id, entry_id))),
  matches as (select *, {TOTAL} from allm)"""
RANKED = """ranked as (select m.*, q.query, q.k, row_number() over (partition by m.query_id order by total_cost, static_cost, entry_id,
      case match_type when 'English' then 1 when 'Traditional' then 2 else 0 end) rank
    from matches m join qset q using (query_id))"""
LEX_SEARCH = f"with {LEX}, {QS}, {SEARCH_BASE}, {SYLLABLE}, {english('lex')}, {HEADWORD}, {ALL}"
M_COLS = "query_id, entry_id, match_type, term_match_cost, unmatched_position_cost, inversion_cost, static_cost, total_cost"


def escape(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x},'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#x27;')"


# Every hit's strings in parts: j reading, c headword, d definitions. All spans are of characters, as only
# headwords go beyond ASCII and theirs are told in characters. Queries have one or two terms.
RENDER = f"""{LEX_SEARCH}, {RANKED}, top as (select * from ranked where rank <= k),
  hit as (select q.query_id, q.idx, q.n_terms, e.entry_key, e.pos, m.match_cost c from qterm q join tm m on m.term_base = q.base and m.match_cost is not null
          join esyl e on e.base = m.base where q.tone is null or q.tone = e.tone),
  pairs as (select query_id, entry_key, c, pos p0, null::bigint p1 from hit where n_terms = 1
            union all select a.query_id, a.entry_key, a.c + b.c, a.pos, b.pos from hit a join hit b
              on a.query_id = b.query_id and a.entry_key = b.entry_key and a.idx = 0 and b.idx = 1 and a.pos <> b.pos where a.n_terms = 2),
  best_pair as (select *, row_number() over (partition by query_id, entry_key order by c, p0, p1) rn from pairs),
  path as (select query_id, entry_key, 0 idx, p0 pos from best_pair where rn = 1
           union all select query_id, entry_key, 1, p1 from best_pair where rn = 1 and p1 is not null),
  txt as (select t.query_id, t.rank, t.match_type, 'j' part, 0 di, l.reading d, 0 st from top t join lex l on l.entry_key = t.entry_id
          union all select t.query_id, t.rank, t.match_type, 'c', 0, l.headword, 0 from top t join lex l on l.entry_key = t.entry_id
          union all select query_id, rank, match_type, 'd', i, definitions[i], coalesce(list_sum(list_transform(definitions[1:i-1], lambda x: strlen(x))), 0)
            from (select t.query_id, t.rank, t.match_type, l.definitions, generate_subscripts(l.definitions, 1) i from top t join lex l on l.entry_key = t.entry_id)),
  sy as (select t.query_id, t.rank, q.tok, q.base qbase, q.tone qtone, string_split(l.reading,' ')[p.pos+1] tgt,
           coalesce(list_sum(list_transform(string_split(l.reading,' ')[1:p.pos], lambda x: strlen(x)+1)),0) st
         from top t join path p on p.query_id = t.query_id and p.entry_key = t.entry_id join qterm q on q.query_id = p.query_id and q.idx = p.idx
         join lex l on l.entry_key = t.entry_id where t.match_type = 'Jyutping'),
  sp as (select query_id, rank, 'j' part, 0 di, st + strpos({fold('tgt')},{fold('tok')})-1 s, st + strpos({fold('tgt')},{fold('tok')})-1+strlen(tok) e from sy where strpos({fold('tgt')},{fold('tok')}) > 0
         union all select query_id, rank, 'j', 0, st + strpos({fold('tgt')},{fold('qbase')})-1, st + strpos({fold('tgt')},{fold('qbase')})-1+strlen(qbase) from sy
           where strpos({fold('tgt')},{fold('tok')}) = 0 and qtone is not null and strpos({fold('tgt')},{fold('qbase')}) > 0
         union all select query_id, rank, 'j', 0, st + strlen(tgt)-1, st + strlen(tgt) from sy where strpos({fold('tgt')},{fold('tok')}) = 0 and qtone is not null
         union all select x.query_id, x.rank, 'd', x.di, strpos({fold('x.d')}, q.tok_fold)-1, strpos({fold('x.d')}, q.tok_fold)-1+length(q.tok) from txt x join qterm q using (query_id)
           where x.match_type = 'English' and x.part = 'd' and strpos({fold('x.d')}, q.tok_fold) > 0
         union all select c.query_id, c.rank, 'c', 0, c.i-1, c.i from (select *, generate_subscripts(string_split(d,''),1) i, unnest(string_split(d,'')) ch from txt
           where match_type = 'Traditional' and part = 'c') c join kc on kc.query_id = c.query_id where list_contains(kc.chars, c.ch)),
  i1 as (select *, case when s <= max(e) over (partition by query_id, rank, part, di order by s, e rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end g from sp),
  i2 as (select *, sum(g) over (partition by query_id, rank, part, di order by s, e rows unbounded preceding) gid from i1),
  i3 as (select query_id, rank, part, di, gid, min(s) s, max(e) e from i2 group by all),
  i4 as (select i3.*, x.d, x.st, coalesce(lag(i3.e) over (partition by query_id, rank, part, di order by i3.s), 0) pe from i3 join txt x using (query_id, rank, part, di)),
  body as (select query_id, rank, part, di, max(e) ce, string_agg({escape('substring(d, (pe+1)::bigint, (s-pe)::bigint)')} || '<mark class="hit-highlight">' || {escape('substring(d, (s+1)::bigint, (e-s)::bigint)')} || '</mark>', '' order by s) b from i4 group by all),
  shown as (select x.*, coalesce(b,'') || {escape('substring(x.d, (coalesce(ce,0)+1)::bigint)')} t from txt x left join body using (query_id, rank, part, di)),
  strings as (select query_id, rank, max(case when part = 'c' then if(match_type = 'Traditional', t, d) end) characters,
      max(case when part = 'j' then if(match_type = 'Jyutping', t, d) end) jyutping, list(t order by di) filter (part = 'd') defs from shown group by all),
  told as (select query_id, rank, list([s + st, e + st]::bigint[] order by di, s) spans from i4 group by all),
  hits as (select t.*, s.characters, s.jyutping, s.defs, coalesce(told.spans, []::bigint[][]) spans, l.source from top t join strings s using (query_id, rank)
      join lex l on l.entry_key = t.entry_id left join told using (query_id, rank))"""


def first_hits() -> str:
    ns = ", ".join(f"'{n}'" for n in NEEDLES)
    return f"""fh as (select doc_id, text, n, strpos({fold('text')}, {fold('n')}) p from documents cross join (select unnest([{ns}]) n)),
  raw as (select doc_id, text, strlen(left(text,p-1)) s, strlen(left(text,p-1))+strlen(n) e, p-1 cs, p-1+length(n) ce from fh where p > 0),
  islands as (select *, case when s <= max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end g from raw),
  grp as (select *, sum(g) over (partition by doc_id order by s, e rows unbounded preceding) gid from islands),
  merged as (select doc_id, text, gid, min(s) s, max(e) e, min(cs) cs, max(ce) ce from grp group by all)"""


def merge_strings(source: str, keys: str, alias: str = "spans") -> str:
    """Gaps-and-islands over ``source(keys, s, e)`` into one string per key."""
    return f"""i1 as (select *, case when s <= max(e) over (partition by {keys} order by s, e rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end g from {source}),
  i2 as (select *, sum(g) over (partition by {keys} order by s, e rows unbounded preceding) gid from i1),
  i3 as (select {keys}, gid, min(s) s, max(e) e from i2 group by all),
  i4 as (select {keys}, string_agg(s || '-' || e, ',' order by s) {alias} from i3 group by all)"""


def any_def(needle: str) -> str:
    return f"len(list_filter(definitions, lambda d: contains(d, '{needle}'))) > 0"


def heuristic() -> str:
    return f"""(case when {any_def('abbr.')} then 5000 else 0 end + case when {any_def('M:')} or {any_def('CL:')} then 0 else 5000 end
   + case when {any_def('Surname')} or {any_def('surname')} then 2000 else 0 end + case when {any_def('(Cantonese)')} then 0 else 2000 end
   + case when {any_def('Confucius')} then 5000 else 0 end + case when {any_def('Dynasty')} or {any_def('Dynasties')} then 5000 else 0 end
   + case when {any_def('(Buddhism)')} then 5000 else 0 end)::bigint"""


CUSTOM = f"""(case when {any_def('the')} or {any_def('The')} then 700 else 0 end + case when {any_def('und ')} or {any_def(' que')} then 0 else 40 end
   + case when {any_def('é')} then 9 else 0 end)::bigint"""

FUZZY = f"""with {PART_TERMS}, {DVOCAB} select pt.word term, dvocab.word word,
   (case when starts_with(dvocab.word, pt.word) then 0 else 1 end)::bigint distance from pt cross join dvocab
   where starts_with(dvocab.word, pt.word) or {edit_one('pt.word', 'dvocab.word')}"""


def byte_list(x: str) -> str:
    return f"list_transform(range(0, strlen({x})), lambda i: ('0x' || substring(hex({x}), 2*i+1, 2))::bigint)"


# The rows of the edit table, one per byte of the term: steps from above and the diagonal first, then along the row.
INDEL = f"""with {PART_TERMS}, {DVOCAB},
   pair as (select pt.word term, dvocab.word word, {byte_list('pt.word')} q, {byte_list('dvocab.word')} t
     from pt join dvocab on left(pt.word, 2) = left(dvocab.word, 2)),
   done as (select term, word, list_reduce(list_transform(q, lambda c: [c]), lambda acc, c:
       list_transform([list_transform(range(1, len(acc)+1), lambda j: case when j = 1 then acc[1] + 1
           else least(acc[j] + 1, acc[j-1] + case when t[j-1] = c[1] then 0 else 2 end) end)],
         lambda best: list_transform(best, lambda x, j: list_min(list_transform(best[1:j], lambda y, k: y + j - k))::bigint))[1], range(0, len(t)+1)) r from pair)
   select term, word, list_min(r[2:])::bigint distance from done"""

READINGS = "rd as (select headword, case when entry_key % 3 = 0 then upper(reading) else reading end reading, entry_key line_no from lex)"


def grouped(key: str, value: str, name: str) -> str:
    return f"""with {LEX}, {READINGS},
  g as (select {key}, {fold(value)} f, arg_min({value}, line_no) v, min(line_no) l from rd group by all)
  select {key}, string_agg(v, '|' order by l) {name} from g group by {key}"""


# A "#" cuts the rest of the line, so the brand loses its number and whatever follows.
CUT = "list_transform(definitions, lambda d: split_part(d,'#',1))"
BUILT = f"""with {LEX}, {CCOST},
  fr as (select headword, min(reading) reading from lex where headword not like '%一%' group by headword),
  hcost as (select headword, sum(coalesce(cost, 7000)) c from (select headword, unnest(string_split(headword,'')) ch from (select distinct headword from lex)) left join ccost using (ch) group by headword),
  e as (
   select l.headword, coalesce(f.reading,'') reading, {CUT} definitions, h.c + case when f.reading is null then 10000 else 0 end base_cost, 'CEDict' src
   from lex l left join fr f using (headword) join hcost h using (headword)
   union all
   select headword, reading, {CUT}, 15000 + 1000*len(regexp_extract_all(reading, '{TOKEN}', 1)), 'CCanto' from lex)
  select headword characters, reading jyutping, array_to_string(definitions,'|') english_definitions,
     (base_cost + {heuristic()})::bigint as cost, src entry_source from e"""


def byte_marks(x):
    """ASCII stays; every other byte becomes the same mark, as terms are ASCII and meet none of them."""
    for low, high, n in (("80", "7FF", 2), ("800", "FFFF", 3), ("10000", "10FFFF", 4)):
        x = f"regexp_replace({x}, '[\\x{{{low}}}-\\x{{{high}}}]', repeat(chr(1), {n}), 'g')"
    return x


ORACLES: dict[str, str] = {
    "defs_parse": f"""
      with b as (select 'd' src, doc_id id, text body from documents union all select 'p', page_id, html from pages),
      d as (select src, id, list_filter(list_transform(string_split(split_part(body,'#',1),'/'),
          lambda x: regexp_replace(regexp_replace(x,'^{UNI}',''),'{UNI}$','')), lambda x: x <> '') ds from b)
      select src, id, (generate_subscripts(ds,1)-1)::bigint pos, unnest(ds) definition from d""",
    "defs_dedup": f"""
      with {LDOC}, u as (select entry_key, unnest(definitions) d, generate_subscripts(definitions,1) i from ldoc),
      f as (select *, row_number() over (partition by entry_key, {fold('d')} order by i) r from u)
      select entry_key, (row_number() over (partition by entry_key order by i)-1)::bigint pos, d definition from f where r = 1""",
    "syllable_tokens": f"""
      with {LEX}, s as (select 'l' src, entry_key id, reading s from lex union all select 'p', page_id, html from pages),
      t as (select src, id, regexp_extract_all(s, '{TOKEN}', 1) ts from s),
      u as (select src, id, generate_subscripts(ts,1)-1 pos, unnest(ts) t from t)
      select src, id, pos::bigint pos, left(t, length(t)-1) base, right(t,1)::bigint tone from u""",
    "tone_parse": f"""
      with {LEX}, w as (select unnest({words('reading')}) word from lex union all select unnest({words('html')}) from pages)
      select word, regexp_replace(word,'[0-9]$','') base, try_cast(nullif(regexp_extract(word,'[0-9]$'),'') as bigint) tone, count(*) n from w group by all""",
    "query_tokens": f"""
      with t as (select conv_id, turn, {words('text')} ts from conversations)
      select conv_id, turn, (generate_subscripts(ts,1)-1)::bigint pos, unnest(ts) tok from t""",
    "char_explode": """
      with t as (select string_split(text,'') cs from documents), u as (select generate_subscripts(cs,1)-1 pos, unnest(cs) ch from t)
      select ch, count(*) n, min(pos)::bigint first_pos, max(pos)::bigint last_pos from u where ch <> '' group by ch""",
    "ci_equals": f"""
      with a as (select distinct unnest({words('text')}) word from benchmark), b as (select distinct unnest({words('text')}) other from documents)
      select word, other from a join b on {fold('word')} = {fold('other')}""",
    "ci_index_of": f"""
      select doc_id, n needle, case when strpos({fold('text')},{fold('n')}) > 0 then strlen(left(text, strpos({fold('text')},{fold('n')})-1)) end::bigint off
      from documents cross join (select unnest([{', '.join(f"'{n}'" for n in NEEDLES)}]) n)""",
    "local_levenshtein": f"""
      with {PART_TERMS}, nm as (select distinct p_name from part),
      sub as (select distinct p_name, substring(p_name, i::bigint, l::bigint) s from nm, range(1, 40) a(i), range(1, 40) b(l) where i + l - 1 <= length(p_name)),
      d as (select p_name, word term, min(levenshtein(word, s)) distance from sub cross join pt group by all)
      select p_partkey, term, distance::bigint distance from part join d using (p_name) where distance <= 1""",
    "local_levenshtein_docs": f"""
      with {PART_TERMS}, {LDOC}, ln as (select distinct unnest(definitions) line from ldoc),
      t as (select line, {byte_marks('line')} s from ln),
      places as (select line, s, unnest(range(1, length(s) + 1)) i from t),
      lens as (select distinct unnest([length(word) - 1, length(word), length(word) + 1]) n from pt),
      parts as (select line, substring(s, i::bigint, n::bigint) part from places join lens on i + n - 1 <= length(s) and n > 0),
      near as (select word term, part, levenshtein(word, part) d from (select distinct part from parts) join pt on abs(length(part) - length(word)) <= 1
        where (contains(part, left(word, length(word) // 2)) or contains(part, substring(word, length(word) // 2 + 1))) and levenshtein(word, part) <= 1)
      select term, line, min(d)::int distance from parts join near using (part) group by all""",
    "fuzzy_prefix": FUZZY,
    "prefix_indel": INDEL,
    "cost_heuristic": f"""
      with {LEX}, {LDOC}, b as (select entry_key, source, definitions from ldoc union all select entry_key, source, definitions from lex)
      select entry_key, source, {heuristic()} default_cost, {CUSTOM} custom_cost from b""",
    "static_cost": f"""
      with {LEX}, {LDOC}, b as (select entry_key, source, reading, definitions from lex union all select entry_key, source, '', definitions from ldoc)
      select entry_key, source, (15000 + 1000*len(regexp_extract_all(reading,'{TOKEN}',1)) + {heuristic()} + case when reading = '' then 10000 else 0 end)::bigint as cost from b""",
    "english_cost": f"with {LDOC}, {QD}, {SEARCH_BASE}, {english('ldoc').replace('strlen(q.query) > 2','true')} select query_id, entry_id, term_match_cost, inversion_cost from em",
    "inversion_cost": f"""
      with p as (select doc_id, list_filter([{', '.join(f"strpos({fold('text')}, '{n.lower()}')" for n in NEEDLES)}], lambda x: x > 0) ps from documents)
      select doc_id, len(ps)::bigint n, ({inversions('ps')})::bigint as cost from p""",
    "unmatched_cost": f"""
      with {LDOC}, u as (select entry_key, len(definitions) n, unnest(definitions) d, generate_subscripts(definitions,1)-1 i from ldoc)
      select entry_key, (sum(case when contains(d,'th') then 0 else n+1-i end)*10000)::bigint as cost from u group by entry_key
      union all select entry_key, 0 from ldoc where len(definitions) = 0""",
    "html_escape": f"select page_id, {escape('html')} escaped from pages",
    "merge_spans": f"""
      with {first_hits()} select d.doc_id, coalesce((select string_agg(s || '-' || e, ',' order by s) from merged m where m.doc_id = d.doc_id), '') spans from documents d""",
    "highlight": f"""
      with {first_hits()}, prv as (select *, coalesce(lag(ce) over (partition by doc_id order by cs), 0) pe from merged),
      body as (select doc_id, string_agg({escape('substring(text, pe+1, cs-pe)')} || '<mark class="hit-highlight">' || {escape('substring(text, cs+1, ce-cs)')} || '</mark>', '' order by cs) b, max(ce) ce from prv group by doc_id)
      select d.doc_id, coalesce(b,'') || {escape('substring(d.text, coalesce(ce,0)+1)')} marked from documents d left join body using (doc_id)""",
    "src_bilingual": f"with {LEX} select headword, array_to_string({CUT},'|') definitions from lex",
    "src_romanised": f"with {LEX} select headword, reading, array_to_string({CUT},'|') definitions from lex",
    "build_lexicon": BUILT,
    "src_readings": f"with {LEX} select headword, reading from lex",
    "src_char_freq": f"with {CFREQ} select idx::bigint idx, ch, cnt::bigint as count, round(cum_pct::float::double*1000)::bigint cum_milli from cfreq",
    "lexicon_roundtrip": f"with {LEX} select entry_key entry_id, headword characters, reading jyutping, array_to_string(definitions,'|') english_definitions, static_cost::bigint as cost, source entry_source from lex",
    "build_report": f"""
      with {LEX}, s as (select unnest(regexp_extract_all(reading,'{TOKEN}',1)) t from lex)
      select count(*) n_entries, count(*) filter (source='A') n_bilingual, count(*) filter (source='B') n_romanised,
        sum(len(definitions))::bigint n_definitions, sum(strlen(array_to_string(definitions,'')))::bigint definition_bytes,
        (select count(*) from s) n_syllable_positions, (select count(distinct ch) from (select unnest(string_split(headword,'')) ch from lex)) n_characters,
        (select count(distinct left(t,length(t)-1)) from s) n_syllables from lex""",
    "freq_from_cumulative": f"with {CCOST} select ch, idx::bigint idx, round(f::double*1e6)::bigint freq_micro from ccost",
    "freq_cost": f"with {CCOST} select ch, cost from ccost",
    "freq_last_wins": "select ch, arg_max(n_chars, doc_id) as count, max(doc_id) idx from (select distinct unnest(string_split(text,'')) ch, n_chars, doc_id from documents) where ch <> '' group by 1",
    "freq_backfill": f"""
      with {LEX}, {CCOST}, lc as (select distinct unnest(string_split(headword,'')) ch from lex)
      select ch, idx::bigint idx, cnt::bigint as count, cost from ccost union all select ch, 10000, 1, 10000 from lc anti join ccost using (ch)""",
    "char_static_cost": f"""
      with {LEX}, {CCOST}, h as (select distinct headword from (select unnest({words('text')}) headword from conversations union all select headword from lex)),
      c as (select headword, unnest(string_split(headword,'')) ch from h)
      select headword, sum(coalesce(cost,7000))::bigint char_cost from c left join ccost using (ch) group by headword""",
    "annotate_readings": f"""
      with {LEX}, f as (select headword, arg_min(reading, entry_key) r from lex where source='B' group by headword)
      select entry_key, headword, coalesce(r,'') reading from lex left join f using (headword) where source='A'""",
    "readings_grouped": grouped("headword", "reading", "readings"),
    "readings_reverse": grouped("reading", "headword", "headwords"),
    "vocab_chars": f"with {LEX}, c as (select distinct entry_key, unnest(string_split(headword,'')) ch from lex) select ch, count(*) n_entries from c group by ch",
    "vocab_syllables": f"""
      with {LEX}, s as (select entry_key, unnest(regexp_extract_all(reading,'{TOKEN}',1)) t from lex)
      select left(t,length(t)-1) base, count(distinct entry_key) n_entries from s group by 1""",
    "encode_vocab": f"""
      with {LEX}, c as (select entry_key, generate_subscripts(string_split(headword,''),1)-1 pos, unnest(string_split(headword,'')) ch from lex),
      s as (select entry_key, generate_subscripts(ts,1)-1 pos, unnest(ts) t from (select entry_key, regexp_extract_all(reading,'{TOKEN}',1) ts from lex)),
      ci as (select ch, row_number() over (order by ch)-1 id from (select distinct ch from c)),
      si as (select b, row_number() over (order by b)-1 id from (select distinct left(t,length(t)-1) b from s))
      select entry_key entry_id, 'char' kind, pos::bigint pos, id::bigint id, null::bigint tone from c join ci using (ch)
      union all select entry_key, 'syllable', pos, id, right(t,1)::bigint from s join si on b = left(t,length(t)-1)""",
    "lexicon_union": f"""
      with {LEX}, {LDOC} select 0::bigint src, entry_key, static_cost::bigint static_cost, source, len(definitions)::bigint n_defs from lex
      union all select 1, entry_key, static_cost, source, len(definitions) from ldoc""",
    "entry_ids": f"""
      with {LEX}, {LDOC}, b as (select 0::bigint src, entry_key, static_cost from lex union all select 1, entry_key, static_cost from ldoc)
      select src, entry_key, row_number() over (order by static_cost, src, entry_key)-1 entry_id from b""",
    "running_offsets": f"""
      with {LDOC}, b as (select static_cost::bigint static_cost, entry_key, strlen(array_to_string(definitions,''))::bigint bytes from ldoc)
      select *, coalesce(sum(bytes) over (order by static_cost, entry_key rows between unbounded preceding and 1 preceding),0)::bigint as start from b""",
    "search_syllable": f"with {LEX}, {QS}, {SEARCH_BASE}, {SYLLABLE} select *, {TOTAL} from jm",
    "search_english": f"with {LEX}, {QS}, {SEARCH_BASE}, {english('lex')} select *, {TOTAL} from em",
    "search_english_docs": f"with {LDOC}, {QD}, {SEARCH_BASE}, {english('ldoc')} select *, {TOTAL} from em",
    "search_headword": f"with {LEX}, {QS}, {HEADWORD} select *, {TOTAL} from tm_h",
    "search_all": f"{LEX_SEARCH} select {M_COLS} from matches",
    "search_topk": f"{LEX_SEARCH}, {RANKED} select {M_COLS}, rank from ranked where rank <= k",
    "search_docs_words": f"""
      with {LDOC}, bw as (select distinct unnest({words('text')}) query from benchmark),
      qset as (select row_number() over (order by query)-1 query_id, query, 12 k from bw), {SEARCH_BASE}, {english('ldoc')},
      matches as (select *, {TOTAL} from em), {RANKED} select {M_COLS}, rank from ranked where rank <= k""",
    "search_pages": f"""
      {LEX_SEARCH.replace('qset as (', 'qset0 as (').replace(SEARCH_BASE, ' qset as (select query_id*10+page query_id, query, (12*2^page)::bigint k from qset0 cross join range(3) p(page)), ' + SEARCH_BASE)}, {RANKED},
      t as (select query_id, k, entry_id, match_type, total_cost, rank from ranked where rank <= k)
      select query_id, k, entry_id, match_type, total_cost, rank, (count(*) over (partition by query_id) = k)::bigint has_more from t""",
    "candidate_counts": f"{LEX_SEARCH} select q.query_id, count(m.query_id) internal_candidates from qset q left join matches m using (query_id) group by 1",
    "term_syllable_match": f"""
      with {QS}, {DVOCAB}, {SEARCH_BASE}, c as (select q.base term_base, v.word base, ({term_cost('q.base','q.base_fold','v.word')})::bigint match_cost
        from (select distinct base, base_fold from qterm) q cross join dvocab v) select * from c where match_cost is not null""",
    "best_term_position": f"""
      with {LEX}, {QS}, {SEARCH_BASE}, {SYLLABLE} select query_id, idx::bigint term_idx, entry_key entry_id, (b >> 31)::bigint as cost, (b & 2147483647)::bigint pos from best""",
    "spans_english": f"""
      with {LDOC}, {QD}, {SEARCH_BASE}, u as (select entry_key, generate_subscripts(definitions,1)-1 def_idx, unnest(definitions) d from ldoc),
      h as (select query_id, entry_key, def_idx, tok, d, strpos({fold('d')}, tok_fold) p from u cross join qterm),
      sp as (select query_id, entry_key, def_idx, strlen(left(d,p-1)) s, strlen(left(d,p-1))+strlen(tok) e from h where p > 0),
      {merge_strings('sp', 'query_id, entry_key, def_idx')} select query_id, entry_key, def_idx::bigint def_idx, spans from i4""",
    "spans_headword": f"""
      with {LEX}, {QS}, {HEADWORD}, c as (select t.query_id, t.entry_id, generate_subscripts(string_split(headword,''),1)-1 s, unnest(string_split(headword,'')) ch
         from tm_h t join lex l on l.entry_key = t.entry_id),
      sp as (select c.query_id, c.entry_id, s, s+1 e from c join kc on kc.query_id = c.query_id where list_contains(kc.chars, c.ch)),
      {merge_strings('sp', 'query_id, entry_id')} select query_id, entry_id, spans from i4""",
    "spans_syllable": f"""
      with {LEX}, w as (select distinct unnest({words('p_name')}) w from part),
      q0 as (select distinct unnest([w, w||'3', left(w,2), left(w,2)||'4']) query from w),
      qset as (select row_number() over (order by query)-1 query_id, query, 1 k from q0), {SEARCH_BASE}, {SYLLABLE},
      a as (select b.query_id, b.entry_key, q.tok, q.base qbase, q.tone qtone, b.b & 2147483647 pos, l.reading, string_split(l.reading,' ') ts
        from best b join qterm q on q.query_id = b.query_id join lex l on l.entry_key = b.entry_key),
      t as (select *, ts[pos+1] tgt, coalesce(list_sum(list_transform(ts[1:pos], lambda x: strlen(x)+1)),0) st from a),
      sp as (select query_id, entry_key, st + strpos({fold('tgt')},{fold('tok')})-1 s, st + strpos({fold('tgt')},{fold('tok')})-1+strlen(tok) e from t where strpos({fold('tgt')},{fold('tok')}) > 0
         union all select query_id, entry_key, st + strpos({fold('tgt')},{fold('qbase')})-1, st + strpos({fold('tgt')},{fold('qbase')})-1+strlen(qbase) from t
           where strpos({fold('tgt')},{fold('tok')}) = 0 and qtone is not null and strpos({fold('tgt')},{fold('qbase')}) > 0
         union all select query_id, entry_key, st + strlen(tgt)-1, st + strlen(tgt) from t where strpos({fold('tgt')},{fold('tok')}) = 0 and qtone is not null),
      {merge_strings('sp', 'query_id, entry_key')}
      select jm.query_id, jm.entry_id, {TOTAL}, coalesce(spans,'') spans from jm left join i4 on i4.query_id = jm.query_id and i4.entry_key = jm.entry_id""",
    "syllable_assignment": f"""
      with {LEX}, qset as (select min(p_partkey) query_id, p_name query, 1 k from part group by p_name), {SEARCH_BASE}, {SYLLABLE},
      h as (select q.query_id, q.idx, e.entry_key, e.pos, m.match_cost c from qterm q join tm m on m.term_base = q.base and m.match_cost is not null
            join esyl e on e.base = m.base where q.tone is null or q.tone = e.tone),
      pr as (select a.query_id, a.entry_key, a.c + b.c c, a.pos p0, b.pos p1 from h a join h b on a.query_id = b.query_id and a.entry_key = b.entry_key and a.idx = 0 and b.idx = 1 and a.pos <> b.pos),
      r as (select *, row_number() over (partition by query_id, entry_key order by c, p0, p1) rn from pr)
      select jm.query_id, jm.entry_id, r.p0 || ',' || r.p1 as path from jm left join r on r.query_id = jm.query_id and r.entry_key = jm.entry_id and rn = 1""",
    "search_render": f"""{RENDER} select query_id, rank, entry_id, match_type, total_cost, characters, jyutping,
      array_to_string(defs, '|') english_definitions, static_cost as "cost", source entry_source from hits""",
    "search_json": f"""{RENDER}, item as (select query_id, rank, {{'match_obj': {{'match_obj': {{'cost_info': {{'term_match_cost': term_match_cost,
        'unmatched_position_cost': unmatched_position_cost, 'inversion_cost': inversion_cost, 'static_cost': static_cost}}, 'match_type': match_type, 'entry_id': entry_id}},
        'matched_spans': spans}}, 'rendered_entry': {{'characters': characters, 'jyutping': jyutping, 'english_definitions': defs, 'cost': static_cost, 'entry_source': source}},
        'query': query}} item from hits),
      page as (select query_id, list(item order by rank) results from item group by all)
      select qset.query_id, case when results is null then '{{"results":[]}}' else to_json({{'results': results}})::varchar end json from qset left join page using (query_id)""",
    "search_render_docs": f"""
      with {LDOC}, {QD}, {SEARCH_BASE}, {english('ldoc')}, matches as (select *, {TOTAL} from em), {RANKED},
      u as (select r.query_id, r.rank, r.entry_id, r.total_cost, generate_subscripts(l.definitions,1) di, unnest(l.definitions) d
            from ranked r join ldoc l on l.entry_key = r.entry_id where r.rank <= r.k),
      h as (select u.*, q.tok, strpos({fold('u.d')}, q.tok_fold) p from u join qterm q using (query_id)),
      sp as (select *, strlen(left(d,p-1)) s, strlen(left(d,p-1))+strlen(tok) e, p-1 cs, p-1+length(tok) ce from h where p > 0),
      i1 as (select *, case when s <= max(e) over (partition by query_id, rank, di order by s, e rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end g from sp),
      i2 as (select *, sum(g) over (partition by query_id, rank, di order by s, e rows unbounded preceding) gid from i1),
      i3 as (select query_id, rank, di, d, gid, min(cs) cs, max(ce) ce from i2 group by all),
      i4 as (select *, coalesce(lag(ce) over (partition by query_id, rank, di order by cs), 0) pe from i3),
      body as (select query_id, rank, di, max(ce) ce, string_agg({escape('substring(d, pe+1, cs-pe)')} || '<mark class="hit-highlight">' || {escape('substring(d, cs+1, ce-cs)')} || '</mark>', '' order by cs) b from i4 group by all),
      defs as (select u.*, coalesce(b,'') || {escape('substring(u.d, coalesce(ce,0)+1)')} t from u left join body using (query_id, rank, di))
      select query_id, rank, entry_id, total_cost, string_agg(t, '|' order by di) english_definitions from defs group by all""",
    "session_page_size": """
      with l as (select user_id, ts, event_id, case when event_type in ('view','click') then null else event_type end q from events),
      p as (select *, last_value(q ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) pq from l),
      r as (select *, sum(case when q is not null and q <> coalesce(pq,'') then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) g from p),
      n as (select *, sum(case when q is null then 1 else 0 end) over (partition by user_id, g order by ts, event_id rows unbounded preceding) presses from r)
      select user_id as "session", event_id, presses::bigint presses, (case when presses <= 59 then 12 << least(presses,59)::bigint else 9223372036854775807 end)::bigint page_size from n""",
}
ORACLES["entries_display"] = ORACLES["entries_json"] = ORACLES["lexicon_roundtrip"]
