"""Plain SQL for the named queries, over the same tables, for an independent engine."""

from __future__ import annotations

# Fixed values, written out here so that a wrong list in the package shows.
PHASES = ("setup", "audio_extract", "fingerprint", "funasr", "faster_whisper", "quality_gate", "writeback", "verify")
PHASE_LABELS = {
    "audio_extract": "音频提取", "fingerprint": "视频完整性校验", "funasr": "FunASR 转写", "faster_whisper": "faster-whisper 转写",
    "quality_gate": "质量门禁", "writeback": "写回", "verify": "写回",
}
STATUS_LABELS = {
    "prepared": "已准备", "running": "运行中", "staged_all": "已暂存（全部候选）", "staged_partial": "已暂存（部分候选）",
    "committed": "已完成", "unknown": "未知",
}
VIDEO_SUFFIXES = (
    ".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".ts", ".m2ts", ".mts", ".ogv", ".mpg", ".mpeg", ".3gp",
    ".rmvb", ".rm", ".vob", ".asf", ".f4v", ".divx",
)
DROPPED_MARKS = "，。！？；：、…“”‘’《》【】,.!?;:"

ORACLE: dict[str, str] = {}

CRLF = "chr(13)||chr(10)"
BLANK = "' '||chr(13)||chr(10)||chr(9)"


def _list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def _twice(x: str, pattern: str, into: str) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, '{pattern}', {into}, 'g')"
    return x


def norm(x: str) -> str:
    """Caption text; kept marks are hidden behind control characters while the others go."""
    x = f"regexp_replace({x}, '<\\|[^|>]+\\|>', '', 'g')"
    x = f"regexp_replace({x}, '[\\r\\n\\t]+', ' ', 'g')"
    x = _twice(x, "([A-Za-z0-9])\\.([A-Za-z0-9])", "'\\1'||chr(1)||'\\2'")
    x = _twice(x, "([0-9]):([0-9])", "'\\1'||chr(2)||'\\2'")
    x = _twice(x, f"([A-Za-z0-9])[{DROPPED_MARKS}]([A-Za-z0-9])", "'\\1 \\2'")
    x = f"regexp_replace({x}, '[{DROPPED_MARKS}]', '', 'g')"
    x = f"replace(replace({x}, chr(1), '.'), chr(2), ':')"
    return f"trim(regexp_replace({x}, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}]+', ' ', 'g'))"


def cmp(x: str) -> str:
    return f"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\pL\\pN]', '', 'g')"


def tokens(x: str) -> str:
    found = f"regexp_extract_all({x}, '[A-Za-z]+(?:[._+#/-][A-Za-z0-9]+)*|\\d+(?:\\.\\d+)?')"
    return f"list_sort(list_distinct(list_transform({found}, lambda v: lower(v))))"


def hms(sec: str) -> str:
    return (
        f"(case when {sec} >= 3600 then printf('%d:%02d:%02d', {sec}//3600, {sec}//60%60, {sec}%60) "
        f"else printf('%02d:%02d', {sec}//60, {sec}%60) end)"
    )


def pick(values, index: str) -> str:
    return f"{_list(values)}[cast({index} as int)]"


# --- shared tables -------------------------------------------------------------------------------

PIECES = f"""
ch as (select conv_id sample_id, turn, text, unnest(generate_series(0, cast(ceil(length(text)/24.0) as bigint)-1)) c from conversations),
b as (select sample_id, cast(row_number() over (partition by sample_id order by turn, c) - 1 as bigint) seg_index,
  substr(text, cast(c*24+1 as int), 24) piece,
  cast(case when sample_id%11=0 then 20 when sample_id%11=1 then 60 else 110+(sample_id%5)*60 end as bigint) k from ch),
b2 as (select sample_id, seg_index, k*length(piece) ms,
  case when sample_id%9=0 and seg_index<5 or sample_id%9=1 and seg_index<4 then 'same line again' else piece end text from b),
t as (select *, cast(coalesce(sum(ms) over (partition by sample_id order by seg_index
  rows between unbounded preceding and 1 preceding),0) as bigint) st from b2),
pieces as (select 'run'||(sample_id%40) run_id, sample_id, seg_index, st start_ms, st+ms end_ms, text from t),
prim as (select * from pieces where seg_index%7<>5),
sec as (select run_id, sample_id, seg_index, start_ms+200 start_ms, end_ms+200 end_ms,
  case when sample_id%13=1 then substr(text,1,8) when sample_id%13=2 then substr(text,1,15)
       when (sample_id+seg_index)%10=4 then text||' 42' else text end text,
  cast(-((7*sample_id+3*seg_index)%(case when sample_id%2=0 then 10 else 15 end)) as double)/10.0::double avg_logprob,
  cast((sample_id+5*seg_index)%(case when sample_id%4<2 then 6 else 10 end) as double)/10.0::double no_speech_prob
  from pieces where seg_index%5<>3 and not (sample_id%3=0 and seg_index%10 in (4,5))),
both_engines as (select 'funasr' engine, run_id, sample_id, seg_index, start_ms, end_ms, text from prim
  union all select 'faster_whisper', run_id, sample_id, seg_index, start_ms, end_ms, text from sec),
cand as (select run_id, sample_id, (max(end_ms)+500)/1000.0::double duration_seconds,
  '/v/'||run_id||'/s'||sample_id||'.mp4' video_path, '/v/'||run_id||'/s'||sample_id||'.txt' target_path
  from both_engines group by 1, 2),
fails as (select run_id, sample_id, video_path, {pick(PHASES, 'sample_id%8+1')} phase,
  'failed in '||{pick(PHASES, 'sample_id%8+1')} reason from cand where sample_id%17=3)"""

DAMAGED = f"""
outs as (select run_id, sample_id, e.engine, case when sample_id%12=5 and e.engine='faster_whisper' then duration_seconds+0.25 else duration_seconds end duration_seconds
  from cand, (values ('funasr'), ('faster_whisper')) e(engine)),
dam as (select engine, run_id, sample_id, seg_index,
  case when sample_id%10=1 and seg_index=6 then 0 when sample_id%10=2 and seg_index=0 then -5 else start_ms end start_ms,
  case when sample_id%10=3 and seg_index=7 then start_ms when sample_id%10=4 and seg_index=4 then end_ms+900000000 else end_ms end end_ms,
  case when sample_id%10=5 and seg_index=2 then {BLANK} else text end text
  from both_engines where sample_id%10<>6 or engine='funasr'),
judged as (select d.*, lag(d.start_ms, 1, -1) over (partition by d.engine, d.sample_id order by seg_index) prev, o.duration_seconds
  from dam d join outs o on d.sample_id=o.sample_id and d.engine=o.engine),
verdict as (select o.run_id, o.sample_id, o.engine, count(j.seg_index) segment_count,
  min(case when start_ms<0 or end_ms<=start_ms or start_ms<prev or end_ms>ceil(j.duration_seconds*1000)+5000 or trim(text, {BLANK})='' then seg_index end) first_bad_index
  from outs o left join judged j on j.sample_id=o.sample_id and j.engine=o.engine group by 1,2,3)"""

ALIGN = f"""
pairs as (select s.run_id, s.sample_id, s.seg_index secondary_index, p.seg_index primary_index,
  least(s.end_ms,p.end_ms)-greatest(s.start_ms,p.start_ms) overlap_ms, p.text ptext
  from sec s join prim p on s.sample_id=p.sample_id and least(s.end_ms,p.end_ms)-greatest(s.start_ms,p.start_ms)>0),
hit as (select sample_id, secondary_index, string_agg(ptext, '' order by primary_index) primary_text,
  string_agg(cast(primary_index as varchar), '|' order by primary_index) primary_indexes from pairs group by 1,2),
matched as (select s.run_id, s.sample_id, s.seg_index secondary_index, s.start_ms, s.end_ms, s.text secondary_text,
  coalesce(h.primary_text,'') primary_text, coalesce(h.primary_indexes,'') primary_indexes
  from sec s left join hit h on h.sample_id=s.sample_id and h.secondary_index=s.seg_index),
lone as (select * from prim p where not exists (select 1 from pairs x where x.sample_id=p.sample_id and x.primary_index=p.seg_index)),
tok as (select *, {tokens('primary_text')} pt, {tokens('secondary_text')} st from matched),
mism as (select *, list_sort(list_concat(list_filter(pt, lambda v: not list_contains(st, v)), list_filter(st, lambda v: not list_contains(pt, v)))) mm from tok),
align as (select run_id, sample_id, secondary_index, primary_indexes, start_ms, end_ms, primary_text, secondary_text,
  array_to_string(mm,'|') token_mismatch, primary_indexes='' or len(mm)>0 high_risk, 'keep_primary_review_secondary' decision from mism
  union all select run_id, sample_id, null, cast(seg_index as varchar), start_ms, end_ms, text, '', array_to_string({tokens('text')},'|'), true, 'keep_primary_missing_secondary' from lone),
risk as (select run_id, sample_id, count(*) alignment_count, count(*) filter (where high_risk) high_risk_count from align group by 1,2)"""



def longest(x: str, y: str) -> str:
    """The longest common block of two texts, of equal ones the first in x, then the first in y: (l, i, j) from 1."""
    found = (
        f"list_max(flatten(list_transform(range(1, length({x})+1), lambda i: list_transform(range(1, length({x})-i+2), "
        f"lambda l: {{'l': case when instr({y}, substr({x}, i, l))>0 then l else 0 end, 'back': -i}}))))"
    )
    return f"list_transform([{found}], lambda m: {{'l': m.l, 'i': -m.back, 'j': instr({y}, substr({x}, -m.back, m.l))}})[1]"


# The ratio by its definition: twice the characters in common blocks over all characters; the longest block first, then
# the same left and right of it. Texts of 200 characters or more would need the rule for popular characters.
RATIOS = f"""{ALIGN[:ALIGN.index("align as (")]}
folded as (select *, {cmp('primary_text')} fa, {cmp('secondary_text')} fb from mism),
work as (select fa, fb, fa x, fb y, {longest('fa', 'fb')} t from (select distinct fa, fb from folded where fa<>'' and fb<>'' and fa<>fb)
  union all select fa, fb, c.x, c.y, {longest('c.x', 'c.y')} from (select fa, fb, unnest([{{'x': substr(x, 1, t.i-1), 'y': substr(y, 1, t.j-1)}},
    {{'x': substr(x, t.i+t.l), 'y': substr(y, t.j+t.l)}}]) c from work where t.l>0) where c.x<>'' and c.y<>''),
shared as (select fa, fb, sum(t.l) common from work group by 1,2),
ratio as (select f.*, case when f.fa='' or f.fb='' then 0.0::double when f.fa=f.fb then 1.0::double else 2.0::double*common/(length(f.fa)+length(f.fb)) end r
  from folded f left join shared s on s.fa=f.fa and s.fb=f.fb),
align as (select run_id, sample_id, secondary_index, primary_indexes, start_ms, end_ms, primary_text, secondary_text, round_even(r, 6) similarity_ratio,
  array_to_string(mm,'|') token_mismatch, primary_indexes='' or len(mm)>0 or r<0.6 high_risk, 'keep_primary_review_secondary' decision from ratio
  union all select run_id, sample_id, null, cast(seg_index as varchar), start_ms, end_ms, text, '', 0.0::double, array_to_string({tokens('text')},'|'), true, 'keep_primary_missing_secondary' from lone),
risk as (select run_id, sample_id, count(*) alignment_count, count(*) filter (where high_risk) high_risk_count, median(similarity_ratio) median_similarity_ratio from align group by 1,2)"""


def whole(sql: str) -> str:
    """The same over all pieces: the gaps in the primary side matter only beside the other engine."""
    return sql.replace("prim as (select * from pieces where seg_index%7<>5)", "prim as (select * from pieces)")


WHOLE = whole(PIECES)

CAPTIONS = f"""
blocks as (select * from (select run_id, sample_id, seg_index, start_ms, end_ms, greatest(0, start_ms//1000) sec, {norm('text')} caption from prim) where caption<>''),
caps as (select run_id, sample_id, string_agg({hms('sec')}||{CRLF}||caption||{CRLF}, {CRLF} order by start_ms, end_ms, seg_index) caption from blocks group by 1,2),
gaps as (select *, sec-lag(sec) over (partition by sample_id order by start_ms, end_ms, seg_index) gap from blocks),
metrics as (select run_id, sample_id, count(*) segment_count, median(length(caption))::double median_text_chars, max(length(caption)) max_text_chars,
  coalesce(median(gap),0)::double median_gap_seconds, {hms('min(sec)')} first_timestamp, {hms('max(sec)')} last_timestamp from gaps group by 1,2),
digests as (select run_id, sample_id, octet_length(encode(caption)) caption_size, sha256(caption) caption_sha256 from caps)"""

QUALITY = f"""
lengths as (select run_id, sample_id, sum(p)::bigint primary_segments, sum(1-p)::bigint secondary_segments, sum(p*n)::bigint primary_chars, sum((1-p)*n)::bigint secondary_chars
  from (select run_id, sample_id, 1 p, length({cmp(norm('text'))}) n from prim union all select run_id, sample_id, 0, length({cmp('text')}) from sec) group by 1,2),
dup0 as (select run_id, sample_id, seg_index, {cmp('text')} c from prim),
dup1 as (select *, lag(c) over (partition by sample_id order by seg_index) pc from dup0),
dup2 as (select *, sum(case when c='' or pc is null or pc<>c then 1 else 0 end) over (partition by sample_id order by seg_index) g from dup1),
dups as (select run_id, sample_id, max(n) longest_duplicate_run from (select run_id, sample_id, g, count(*) n from dup2 group by 1,2,3) group by 1,2),
conf as (select run_id, sample_id, avg(avg_logprob) avg_logprob_mean, min(avg_logprob) avg_logprob_min, max(no_speech_prob) no_speech_prob_max, count(*) checked_segments from sec group by 1,2),
q0 as (select c.run_id, c.sample_id, c.duration_seconds, c.video_path, c.target_path,
  coalesce(primary_segments,0) primary_segments, coalesce(secondary_segments,0) secondary_segments, coalesce(primary_chars,0) primary_chars, coalesce(secondary_chars,0) secondary_chars,
  coalesce(longest_duplicate_run,1) longest_duplicate_run, avg_logprob_min, no_speech_prob_max, coalesce(high_risk_count,0) high_risk_count,
  m.sample_id is not null rendered, coalesce(median_text_chars,0) median_text_chars, c.duration_seconds/60.0::double mins
  from cand c left join lengths l using (run_id, sample_id) left join dups using (run_id, sample_id) left join conf using (run_id, sample_id)
  left join metrics m on m.sample_id=c.sample_id left join risk r on r.sample_id=c.sample_id),
q1 as (select *, primary_chars/mins text_density, case when secondary_chars>0 then primary_chars/secondary_chars::double else 'inf'::double end text_length_ratio,
  greatest(3, cast(floor(mins*5) as bigint)) minimum_segments from q0),
q2 as (select *, text_density<30 or text_density>1200 d_err, text_length_ratio='inf'::double or text_length_ratio<0.45 or text_length_ratio>2.2 r_err from q1),
q3 as (select *,
  list_filter([case when not rendered then 'format_empty_caption' end, case when primary_segments<minimum_segments then 'few_segments' end, case when d_err then 'density_error' end,
    case when longest_duplicate_run>4 then 'duplicate_error' end, case when r_err then 'ratio_error' end], lambda v: v is not null) errs,
  list_filter([case when not d_err and (text_density<100 or text_density>600) then 'density_warn' end, case when longest_duplicate_run=4 then 'duplicate_warn' end,
    case when not r_err and (text_length_ratio<0.8 or text_length_ratio>1.4) then 'ratio_warn' end,
    case when rendered and (median_text_chars<3 or median_text_chars>40) then 'median_chars_warn' end,
    case when avg_logprob_min < -1.0 then 'logprob_warn' end, case when no_speech_prob_max>0.6 then 'no_speech_warn' end,
    case when high_risk_count>0 then 'high_risk_warn' end], lambda v: v is not null) warns from q2),
rep as (select *, len(errs)=0 passed, len(warns) warning_count, primary_segments-minimum_segments segment_margin from q3)"""

ALL = f"with {PIECES}, {ALIGN}, {CAPTIONS}, {QUALITY}"

STAGE = """
elig as (select c.* from cand c where not exists (select 1 from fails f where f.sample_id=c.sample_id)),
stages as (select c.run_id, coalesce(bool_and(r.sample_id is not null) filter (where e.sample_id is not null), true) staged_all,
  coalesce(bool_and(coalesce(r.passed,false)) filter (where e.sample_id is not null), true) all_passed,
  coalesce(sum(r.warning_count),0)::bigint warning_count
  from cand c left join elig e on e.sample_id=c.sample_id left join rep r on r.sample_id=c.sample_id group by 1),
entries as (select e.run_id, e.sample_id, e.video_path, e.target_path, d.caption_size target_size, d.caption_sha256 target_sha256
  from elig e join stages s on s.run_id=e.run_id and s.staged_all and s.all_passed join digests d on d.sample_id=e.sample_id)"""

VERIFY = """
pub as (select e.run_id, e.sample_id, e.video_path, e.target_path,
  case when e.sample_id%6<>5 and d.sample_id is not null then case when e.sample_id%10=3 then 0 else d.caption_size end end size,
  case when e.sample_id%6<>5 and d.sample_id is not null then case when e.sample_id%9=2 then '0' else d.caption_sha256 end end sha256,
  d.caption_size, d.caption_sha256 from elig e left join digests d on d.sample_id=e.sample_id),
verified as (select run_id, sample_id, video_path, target_path, size, sha256,
  case when sample_id%11=4 or (sample_id%7=1 and sample_id<>0) then 'video_changed'
       when coalesce(size,0)=0 then 'target_empty'
       when size is distinct from caption_size or sha256 is distinct from caption_sha256 then 'target_differs'
       when sample_id%8=1 then 'format_invalid' end failure_code from pub)"""

RUNS = """
names as (select distinct 'run'||(conv_id%40) run_id from conversations),
nums as (select run_id, cast(substr(run_id,4) as bigint) n from names),
runs as (select run_id, case when n%5=0 then null when n%5=1 then 'staged_partial' when n%5=2 then 'staged_all' else 'committed' end status,
  printf('2026-05-01T08:%02d:00+00:00', n%30) created_at_utc,
  case when n%3<>0 then printf('2026-05-01T08:%02d:00+00:00', n%30+7) end updated_at_utc,
  case when n%4<>0 then n+5 end video_count, case when n%4<>0 then n%7+1 end candidate_count, n from nums)"""

FULL = f"{ALL}, {STAGE}, {VERIFY}, {RUNS}"

CATALOG = f"""with d as (select *, case when doc_id%20=15 then doc_id-5 else doc_id end own from documents),
m as (select doc_id, n_chars length, text,
  '/f'||(own%10)||'/'||case when doc_id%7=0 then 'CLIP' else 'clip' end||own||case when doc_id%20=15 then '.avi' else {pick(('.mp4', '.MKV', '.mov', '.jpg', '.ts'), 'doc_id%5+1')} end path from d),
media as (select doc_id, length, path, doc_id%3 root_ord from m union all select doc_id, length, path, (doc_id+1)%3 from m where doc_id%6=0),
firsts as (select path, min(root_ord) root_ord, any_value(doc_id) doc_id, any_value(length) length from media group by path),
vid as (select * from firsts where lower(regexp_extract(path, '[^/]([.][^./]+)$', 1)) in ({','.join(f"'{s}'" for s in VIDEO_SUFFIXES)})),
targeted as (select *, regexp_replace(path, '[.][^./]+$', '.txt') target_path, lower(regexp_replace(path, '[.][^./]+$', '.txt')) target_key, lower(path) path_key from vid),
texts as (select '/f'||(doc_id%10)||'/'||case when doc_id%7=0 then 'CLIP' else 'clip' end||doc_id||'.txt' path, doc_id, text from documents where doc_id%4<>0 and doc_id%20<>15
  union all select '/f'||(doc_id%10)||'/notes'||doc_id||'.txt', doc_id, text from documents where doc_id%9=0),
txt as (select path, case doc_id%4 when 1 then 0 when 2 then 4 else octet_length(encode(text)) end length,
  case doc_id%4 when 1 then 'zero_byte' when 2 then 'whitespace_only' else 'nonempty' end state from texts),
groups as (select target_key, count(*) video_count from targeted group by 1),
conflicts as (select first_value(t.target_path) over w target_path, g.video_count, row_number() over w as position, t.path video_path
  from targeted t join groups g on g.target_key=t.target_key and g.video_count>1 window w as (partition by t.target_key order by t.root_ord, t.path_key, t.path)),
cands as (select t.*, 'CC-CANDIDATE-'||lpad(cast(row_number() over (order by t.path_key, t.path) as varchar),5,'0') sample_id
  from targeted t join groups g on g.target_key=t.target_key and g.video_count=1),
prot as (select x.path, x.length from txt x where x.length>0 and not exists (select 1 from targeted t where t.target_path=x.path))
"""

SNAP = """with s as (select doc_id, '/s/'||doc_id path, doc_id%13<>0 here, doc_id%17=0 grown,
  case when doc_id%5<>0 then sha256(text) end h, case when doc_id%23<>0 then sha256(case when doc_id%19=0 then text||'!' else text end) end now_h from documents),
v as (select *, here and not grown quick, here and not grown and (h is null or coalesce(now_h=h, false)) full_ok from s)
"""

LINES = f"""with e as (select user_id run_id, event_id line_no, event_type kind, event_id e, case when event_id%2=0 then 'funasr' else 'faster_whisper' end engine,
  'v'||(event_id//2%40) video, {pick(PHASES, 'event_id%8+1')} phase from events),
p as (select run_id, line_no, kind, e,
  case when kind='view' then 'progress'
       when kind='error' and run_id%3<>0 then null when kind='error' and e%7=0 then null when kind='error' then 'error'
       when kind='signup' then 'candidate_failed' when kind='purchase' then 'engine_start'
       when e%5=0 then 'run_dir' when e%5=1 then 'done' end event, engine, video, phase,
  case when kind='error' and run_id%3<>0 then '音频提取失败 '||e
       when kind='error' and e%7=0 then '{{"event": "error", "phase": "nowhere", "reason": "x"}}'
       when kind='click' and e%5=2 then '{{"event": "progress", "engine": "'||engine||'"}}'
       when kind='click' and e%5=3 then '扫描 '||e else '' end plain from e),
parsed as (select run_id, line_no, event, case when event in ('progress','engine_start') then engine end engine,
  case when event='engine_start' then 'cpu' end device, case when event='progress' then e%40 end index, case when event='progress' then 40::bigint end total,
  case when event in ('progress','error','candidate_failed') then video end video_path,
  case when event='run_dir' then '/runs/'||e end path, case when event='done' then '/runs/'||e end run_dir,
  case when event in ('error','candidate_failed') then phase end phase,
  case event when 'error' then 'no '||e when 'candidate_failed' then 'skipped' end reason,
  case when event='candidate_failed' then 'S'||(e%40) end sample_id from p where event is not null)
"""


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = " ".join(sql.split("\n"))


# --- catalog -------------------------------------------------------------------------------------

oracle("media_files", f"{CATALOG} select root_ord::int root_ord, path, regexp_extract(path, '[^/]([.][^./]+)$', 1) suffix, length from media where path not like '%.jpg'")
oracle("first_root_paths", f"{CATALOG} select path, root_ord::int root_ord, doc_id, length from firsts")
oracle("target_keys", f"{CATALOG} select path, target_path, target_key, path_key from targeted")
oracle("target_pairing", f"{CATALOG} select t.path, t.target_path, x.path is not null target_exists, x.length target_length from targeted t left join txt x on x.path=t.target_path")
oracle("target_conflicts", f"{CATALOG} select * from conflicts")
oracle("protected_texts", f"{CATALOG} select * from prot")
oracle("discovery_counts", f"""{CATALOG} select (select count(*) from targeted) video_count, (select count(*) from targeted t where exists (select 1 from txt x where x.path=t.target_path)) matched_text_count,
  (select count(*) from targeted t where not exists (select 1 from txt x where x.path=t.target_path)) missing_text_count,
  (select count(*) from cands) candidate_count, (select count(*) from groups where video_count>1) conflict_count, (select count(*) from prot) protected_count""")
oracle("numbered_candidates", f"{CATALOG} select c.sample_id, c.path video_path, c.target_path, coalesce(x.state,'missing') initial_state from cands c left join txt x on x.path=c.target_path")
oracle("text_states", f"{CATALOG} select path, state from txt")
oracle("exclusions", f"{CATALOG} select sample_id, path video_path, doc_id%9=0 excluded from cands")
oracle("selection_counts", f"""{CATALOG} select (select count(*) from cands) candidate_count, (select count(*) from cands where doc_id%9<>0) selected_count,
  (select count(*) from cands where doc_id%9=0) excluded_count, (select count(*) from groups where video_count>1) conflict_count,
  (select count(*) from conflicts) conflict_video_count, (select count(*) from conflicts) confirmed_excluded_count, (select count(*) from prot) protected_count""")
oracle("cost_estimates", f"{CATALOG} select path, case when doc_id%6<>0 then cast(ceil(30.0::double+doc_id*0.5::double*0.3::double+length*4096/8388608.0::double) as bigint) end estimate_seconds from vid")
oracle("engine_terms", """with c as (select distinct conv_id s, 'run'||(conv_id%40) run_id from conversations),
  x as (select s, run_id, 0 pos, 'Lesson' term from c union all select s, run_id, 1, run_id from c union all select s, run_id, 2, 'T'||(s%1500) from c union all select s, run_id, 3, 'U'||(s%1700) from c),
  y as (select run_id, lower(term) term_key, first(term order by s, pos) term, min(s*10+pos) place from x group by 1, 2)
  select run_id, term_key, term from y qualify row_number() over (partition by run_id order by place) <= 200""")

# --- snapshots -----------------------------------------------------------------------------------

oracle("snapshot_quick", f"{SNAP} select path, quick as matches from v")
oracle("snapshot_full", f"{SNAP} select path, full_ok as matches from v")
oracle("snapshot_tree_changes", """with f as (select doc_id d, doc_id//16 n, (doc_id//16)%7=0 busy, '/s/'||coalesce(source,'none')||'/'||(doc_id//16)||'/'||doc_id path, text is not null has_text, n_chars is not null has_size from documents)
  select path, 'missing' "change" from f where busy and d%11<>0 and d%13=0
  union all select path, 'added' from f where busy and d%11=0 and d%13<>0
  union all select path, 'changed' from f where busy and d%11<>0 and d%13<>0 and ((d%3=0 and has_size) or (d%2=0 and n%5<>0 and has_text))""")
oracle("changed_protected", f"{SNAP} select path from v where not full_ok")
oracle("changed_candidates", f"""{SNAP}, k as (select a.doc_id//2 sample_id, a.path vp, a.quick vq, b.path tp, b.full_ok tf from v a join v b on a.doc_id%2=0 and b.doc_id=a.doc_id+1)
  select 'run'||(sample_id%40) run_id, sample_id, 'video_changed' kind, vp path from k where not vq union all select 'run'||(sample_id%40), sample_id, 'target_changed', tp from k where not tf""")

# --- text and time -------------------------------------------------------------------------------

oracle("normalized_documents", f"select doc_id, {norm('text')} normal from documents")
oracle("normalized_pages", f"select page_id, {norm('html')} normal from pages")
oracle("comparison_documents", f"select doc_id, {cmp('text')} comparison from documents")
oracle("page_tokens", f"select page_id, array_to_string({tokens('html')}, '|') tokens from pages")
oracle("decoded_documents", f"select doc_id, text, {pick(('utf-8', 'utf-16-le', 'utf-16-be', 'utf-8'), 'doc_id%4+1')} as encoding, doc_id%4<>3 bom from documents")
oracle("stripped_logs", "select conv_id, turn, text||' [A] ' line from conversations")
oracle("timecodes", f"with a as (select l_orderkey, l_linenumber, l_orderkey*977+l_linenumber*61000 ms from lineitem) select *, {hms('(ms//1000)')} timecode, ms//1000 as seconds from a")
oracle("probe_durations", "select o_orderkey, case when o_orderkey%5<>0 then (o_orderkey%30)*3600.0::double+(o_orderkey%60)*60+(o_orderkey+7)%60+case when o_orderkey%2=0 then 0.25 else 0 end end as seconds from orders")
oracle("clock_times", "select event_id, case when event_id%4<>1 then epoch(date_trunc('second', ts))::double-case when event_id%4=0 then 7200 else 0 end end epoch, case when event_id%7<>0 then round(event_id%50/(event_id%7)::double, 6) end rtf from events")
oracle("stage_labels", f"""select event_id, {pick(('质量门禁', '音频提取', 'FunASR 转写', 'FunASR 转写', 'faster-whisper 转写', '写回', '扫描', 'fallback', 'fallback'), 'event_id%9+1')} stage,
  {pick(['fallback', *PHASE_LABELS.values()], 'event_id%8+1')} phase_label, case when event_id%3=0 then 'funasr' else 'faster_whisper' end engine_phase,
  {pick((STATUS_LABELS['committed'], STATUS_LABELS['running'], 'other'), 'event_id%3+1')} status_label from events""")

# --- transcripts ---------------------------------------------------------------------------------

oracle("transcript_segments", f"with {PIECES} select * from both_engines")
oracle("secondary_clamps", f"""with {PIECES}, k1 as (select *, (start_ms-300) s, end_ms-case when seg_index%4=0 then 9000 else 0 end e from pieces),
  k2 as (select *, least(60000, greatest(0, s)) st from k1), k3 as (select *, least(60000, greatest(st+1, e)) en from k2)
  select sample_id, seg_index, st start_ms, en end_ms, trim(text, {BLANK}) text from k3 where en>st and trim(text, {BLANK})<>''""")
oracle("primary_clamps", f"""with {PIECES}, k1 as (select *, case when seg_index%5<>0 then least(start_ms, 60000) else 0 end st, case when seg_index%3<>0 then end_ms-case when seg_index%4=0 then 9000 else 0 end end e from pieces),
  k2 as (select *, case when e is null then 60000 else least(60000, greatest(st, e)) end en from k1), k3 as (select *, case when en<=st then least(60000, st+500) else en end en2 from k2)
  select sample_id, seg_index, st start_ms, en2 end_ms, trim(text, {BLANK}) text from k3 where en2>st and trim(text, {BLANK})<>''""")
DOCS = """with a as (select conv_id c, turn, text, 'D'||conv_id//40||'-'||turn nm, 'run'||(conv_id%40) run_id from conversations),
  k as (select *, case when c%11=0 then 'sample_id_mismatch' when c%7=0 then 'source_path_mismatch' when c%5=0 then 'engine_mismatch' else 'accepted' end outcome from a)"""
oracle("document_identity", f"{DOCS} select outcome, count(*) documents from k group by 1")
oracle("document_segments", f"""{DOCS}, x as (select run_id, nm, turn, string_split(text, chr(10)) ls from k where outcome='accepted'), y as (select run_id, nm, turn, ls, unnest(generate_series(0, len(ls)-1)) i from x)
  select run_id, nm sample_id, case when turn%2=0 then 'funasr' else 'faster_whisper' end engine, i seg_index, i*1000 start_ms, i*1000+900 end_ms, ls[i+1] text, -0.5::double avg_logprob from y""")
oracle("raw_result_segments", f"""with c as (select conv_id, turn, trim(text, {BLANK}) t from conversations)
  select conv_id, turn, 0::bigint seg_index, 100::bigint start_ms, 2500::bigint end_ms, t text, null::double confidence from c where conv_id%5 in (0,3)
  union all select conv_id, turn, 0, 700, 1800, t, 0.25 from c where conv_id%5=2
  union all select conv_id, turn, 1, 700, 1800, t, 0.25 from c where conv_id%5=0
  union all select conv_id, turn, 0, 3000, 3500, t, null from c where conv_id%5=1
  union all select conv_id, turn, 1, 4000, 4400, 'second', null from c where conv_id%5=1""")
oracle("raw_result_rejects", "select conv_id, turn, 'no_segments' rejected_reason from conversations where conv_id%5=4")
oracle("segment_validity", f"with {PIECES}, {DAMAGED} select *, case when segment_count=0 then 'no_segments' when first_bad_index is not null then 'invalid_segment' end invalid_reason from verdict")
ORPHANED = """
orph as (select * from dam union all select engine, run_id, sample_id+1000000, seg_index, start_ms, end_ms, text from dam where sample_id%7=3
  union all select engine, run_id, sample_id, null, start_ms, end_ms, text from dam where sample_id%9=2 and seg_index=1),
marked as (select o.*, exists (select 1 from outs x where x.sample_id=o.sample_id and x.engine=o.engine and x.run_id=o.run_id) known from orph o)"""
oracle("orphan_segments", f"""with {PIECES}, {DAMAGED}, {ORPHANED} select run_id, sample_id, engine, seg_index, start_ms, end_ms, text,
  case when not known then 'no_output' else 'no_index' end rejected_reason from marked where not known or seg_index is null""")
oracle("orphan_validity", f"""with {PIECES}, {DAMAGED}, {ORPHANED}, loose as (select sample_id, engine, count(*) n from marked where known and seg_index is null group by 1,2)
  select v.run_id, v.sample_id, v.engine, segment_count+coalesce(n,0) segment_count, first_bad_index, case when segment_count+coalesce(n,0)=0 then 'no_segments'
  when first_bad_index is not null then 'invalid_segment' when n is not null then 'unindexed_segment' end invalid_reason from verdict v left join loose l using (sample_id, engine)""")
oracle("segment_order", f"with {WHOLE} select sample_id, start_ms, end_ms, row_number() over (partition by sample_id order by start_ms, end_ms, 10000-seg_index)-1 seg_index from prim")

# --- alignment -----------------------------------------------------------------------------------

oracle("overlap_pairs", f"with {PIECES}, {ALIGN} select run_id, sample_id, secondary_index, primary_index, overlap_ms from pairs")
oracle("long_overlap_pairs", f"""with {PIECES}, more as (select run_id, sample_id, seg_index, start_ms, end_ms from sec
  union all select run_id, sample_id, max(seg_index)+1, -sample_id-1, 1000000000000000 from sec where sample_id%3=0 group by 1,2)
  select s.run_id, s.sample_id, s.seg_index secondary_index, p.seg_index primary_index, least(s.end_ms,p.end_ms)-greatest(s.start_ms,p.start_ms) overlap_ms
  from more s join prim p on s.sample_id=p.sample_id and least(s.end_ms,p.end_ms)-greatest(s.start_ms,p.start_ms)>0""")
LOOSE = "select run_id, sample_id, seg_index, start_ms, end_ms, text from {0} union all select run_id, sample_id+1000000, seg_index, start_ms, end_ms, text from {0} where sample_id%7=3 union all select run_id, sample_id, null, start_ms, end_ms, text from {0} where sample_id%9=2 and seg_index=1"
oracle("loose_alignments", f"""with {PIECES}, lp as ({LOOSE.format('prim')}), ls as ({LOOSE.format('sec')}),
  np as (select *, row_number() over () k from lp), ns as (select *, row_number() over () k from ls),
  x as (select s.k sk, p.k pk, p.seg_index i, p.text t from ns s join np p on s.sample_id=p.sample_id and least(s.end_ms,p.end_ms)-greatest(s.start_ms,p.start_ms)>0),
  h as (select sk, string_agg(t, '' order by i nulls first, t) primary_text from x group by 1),
  m as (select s.*, coalesce(h.primary_text,'') primary_text, h.sk is null alone from ns s left join h on h.sk=s.k),
  tk as (select *, {tokens('primary_text')} pt, {tokens('text')} st from m),
  mm as (select *, list_sort(list_concat(list_filter(pt, lambda v: not list_contains(st, v)), list_filter(st, lambda v: not list_contains(pt, v)))) d from tk)
  select run_id, sample_id, seg_index secondary_index, start_ms, end_ms, text secondary_text, array_to_string(d,'|') token_mismatch, alone or len(d)>0 high_risk,
  'keep_primary_review_secondary' decision from mm
  union all select run_id, sample_id, null, start_ms, end_ms, '', array_to_string({tokens('text')},'|'), true, 'keep_primary_missing_secondary'
  from np where k not in (select pk from x)""")
oracle("matched_text", f"with {PIECES}, {ALIGN} select run_id, sample_id, secondary_index, start_ms, end_ms, secondary_text, primary_text, primary_indexes from matched")
oracle("unmatched_primary", f"with {PIECES}, {ALIGN} select run_id, sample_id, seg_index, start_ms, end_ms, text from lone")
oracle("alignment_tokens", f"with {PIECES}, {ALIGN} select * from align")
oracle("alignment_ratios", f"with recursive {PIECES}, {RATIOS} select * from align")
oracle("alignment_medians", f"with recursive {PIECES}, {RATIOS} select * from risk")
oracle("alignment_counts", f"with {PIECES}, {ALIGN} select * from risk")
oracle("risky_candidates", f"""with {PIECES}, {ALIGN} select run_id, sample_id, count(*) high_risk_count, min(start_ms) first_risk_ms, count(*) filter (where token_mismatch<>'') token_mismatch_count
  from align where high_risk group by 1,2""")

# --- captions and quality ------------------------------------------------------------------------

oracle("caption_blocks", f"with {WHOLE}, {CAPTIONS} select run_id, sample_id, seg_index, {hms('sec')} timecode, caption from blocks")
oracle("rendered_captions", f"with {WHOLE}, {CAPTIONS} select run_id, sample_id, caption from caps")
oracle("caption_digests", f"with {WHOLE}, {CAPTIONS}, parts as (select sample_id, count(distinct start_ms//60000) part_count from blocks group by 1) select d.run_id, d.sample_id, p.part_count, d.caption_size, d.caption_sha256 from digests d join parts p using (sample_id)")
oracle("caption_metrics", f"with {WHOLE}, {CAPTIONS} select * from metrics")
oracle("caption_checks", f"""with {WHOLE}, {CAPTIONS}, k as (select *, {pick(('ok', 'encoding', 'bare_newline', 'no_final_newline', 'incomplete_block', 'invalid_block', 'missing_blank_line', 'not_monotonic', 'ok'), 'sample_id%9+1')} code from metrics)
  select run_id, sample_id, nullif(code,'ok') format_code, case when code='ok' then segment_count else 0 end segment_count, case when code='ok' then median_text_chars else 0 end median_text_chars,
  case when code='ok' then max_text_chars else 0 end max_text_chars, case when code='ok' then median_gap_seconds else 0 end median_gap_seconds,
  case when code='ok' then first_timestamp else '' end first_timestamp, case when code='ok' then last_timestamp else '' end last_timestamp from k""")
oracle("confidence", f"with {PIECES} select run_id, sample_id, round(avg(avg_logprob),6) avg_logprob_mean, min(avg_logprob) avg_logprob_min, max(no_speech_prob) no_speech_prob_max, count(*) checked_segments from sec group by 1,2")
oracle("text_lengths", f"{ALL} select * from lengths")
oracle("duplicate_runs", f"{whole(ALL)} select * from dups")
oracle("quality_gate", f"""{ALL} select run_id, sample_id, passed, warning_count, high_risk_count, primary_segments, secondary_segments, longest_duplicate_run, text_density, text_length_ratio,
  median_text_chars, array_to_string(errs,'|') errors, array_to_string(warns,'|') warnings from rep""")
oracle("stored_quality_gate", f"""{ALL} select run_id, sample_id, passed, warning_count, high_risk_count, primary_segments, secondary_segments,
  array_to_string(errs,'|') errors, array_to_string(warns,'|') warnings from rep""")
oracle("quality_gate_ratios", f"""with recursive {PIECES}, {RATIOS}, {CAPTIONS}, {QUALITY} select p.run_id, p.sample_id, passed, warning_count, p.high_risk_count,
  coalesce(k.median_similarity_ratio, 0.0::double) median_similarity_ratio, array_to_string(errs,'|') errors, array_to_string(warns,'|') warnings
  from rep p left join risk k on k.run_id=p.run_id and k.sample_id=p.sample_id""")
oracle("quality_reports", f"""{ALL} select r.run_id, r.sample_id, r.passed, r.warning_count, d.caption_size, d.caption_sha256, m.segment_count caption_count, m.median_text_chars, m.max_text_chars,
  m.median_gap_seconds, m.first_timestamp, m.last_timestamp from rep r join digests d on d.sample_id=r.sample_id join metrics m on m.sample_id=r.sample_id""")
METRICS = ("duration_seconds", "text_density", "text_length_ratio", "longest_duplicate_run", "primary_segments", "segment_margin", "median_text_chars")
QUANTS = ", ".join(f"round(quantile_cont(value, {q}), 6) as {n}" for q, n in zip((0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0), ("min", "p10", "p25", "p50", "p75", "p90", "max")))
TALL = " union all ".join(f"select duration_seconds d, '{m}' metric, {m}::double as value from rep" for m in METRICS)
oracle("corpus_profile", f"{ALL}, tall as ({TALL}) select metric, count(*) n, {QUANTS} from tall group by 1")
oracle("bucket_profile", f"""{ALL}, tall as ({TALL}) select case when d<60 then 'under_1m' when d<=300 then '1m_to_5m' when d<=1200 then '5m_to_20m' when d<=10800 then '20m_to_3h' else 'over_3h' end bucket,
  metric, count(*) n, {QUANTS} from tall group by 1,2""")
oracle("density_rank_correlation", f"""{ALL}, a as (select rank() over (order by text_density)+(count(*) over (partition by text_density)-1)/2.0 rx, rank() over (order by duration_seconds)+(count(*) over (partition by duration_seconds)-1)/2.0 ry from rep)
  select count(*) n, round(corr(rx::double, ry::double),6) spearman from a""")

# --- runs ----------------------------------------------------------------------------------------

oracle("pending_candidates", f"with {PIECES}, {DAMAGED} select run_id, sample_id, video_path from cand c where exists (select 1 from verdict v where v.sample_id=c.sample_id and (segment_count=0 or first_bad_index is not null))")
oracle("eligible_candidates", f"with {PIECES} select run_id, sample_id from cand where sample_id%17<>3 and sample_id%3<>0")
oracle("published_reports", f"""with {PIECES} select run_id, sample_id, 'candidates' report, case when (sample_id%40)%2=0 then 2*duration_seconds else duration_seconds end duration_seconds, null::varchar reason from cand
  union all select run_id, sample_id, 'failures', null, reason from fails where (sample_id%40)%2=1 or sample_id%3=0""")
oracle("pilot_phases", f"with {PIECES}, a as (select run_id, sample_id, row_number() over (partition by run_id order by sample_id) candidate_no from cand) select *, case when candidate_no<=2 then 'pilot' else 'remaining' end phase from a")
oracle("duration_mismatches", f"with {PIECES} select run_id, sample_id, duration_seconds primary_duration, duration_seconds+0.25 secondary_duration from cand where sample_id%12=5")
oracle("merged_stage", f"{ALL} select run_id, sample_id, passed, warning_count+case when sample_id%3=0 then 100 else 0 end warning_count from rep where sample_id%2=0 or sample_id%3=0")
oracle("merged_run_table", f"""{ALL} select run_id, sample_id, passed, warning_count+case when sample_id%5=0 then 1000 when sample_id%3=0 then 100 else 0 end warning_count
  from rep where sample_id%2=0 or sample_id%3=0 or sample_id%5=0""")
oracle("stage_states", f"""{ALL}, r as (select * from rep where sample_id%8<>7), elig as (select * from cand where sample_id%17<>3)
  select c.run_id, coalesce(bool_and(r.sample_id is not null) filter (where c.sample_id%17<>3), true) staged_all,
  coalesce(bool_and(coalesce(r.passed,false)) filter (where c.sample_id%17<>3), true) all_passed,
  coalesce(bool_and(coalesce(r.passed,false)) filter (where c.sample_id%17<>3 and c.sample_id%2=0), true) selected_passed,
  count(r.sample_id) staged_count, coalesce(sum(r.warning_count),0)::bigint warning_count, count(*) filter (where r.warning_count>0) warning_sample_count,
  count(*) filter (where r.warning_count>0)>0 has_warnings from cand c left join r on r.sample_id=c.sample_id group by 1""")
oracle("warned_samples", f"{ALL} select run_id, sample_id from rep where warning_count>0")
oracle("broken_staging", f"with {PIECES}, {CAPTIONS} select run_id, sample_id, caption_sha256 from digests where sample_id%5=0")
oracle("commit_entries", f"{FULL} select * from entries")
oracle("published_captions", f"{FULL} select * from verified")
oracle("verification_counts", f"{FULL} select run_id, count(*) filter (where failure_code is null) verified_count, count(*) filter (where failure_code is not null) failure_count, bool_and(failure_code is null) passed from verified group by 1")
oracle("run_summaries", f"""{FULL}, vs as (select run_id, bool_and(failure_code is null) ok, count(*) filter (where failure_code is null) good, count(*) filter (where failure_code is not null) bad from verified group by 1)
  select r.run_id, coalesce(status,'unknown') status, coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in STATUS_LABELS.items())}}}[coalesce(status,'unknown')], status) status_label,
  created_at_utc started_at, case when status='committed' then '2026-05-01T09:00:30+00:00' else coalesce(updated_at_utc, created_at_utc) end ended_at,
  (select count(*) from cand c where c.run_id=r.run_id) candidate_count,
  case when n%4<>0 then greatest(0, video_count-candidate_count) else (select count(*) from cand c where c.run_id=r.run_id and sample_id%4=1) end excluded_count,
  (select count(*) from fails f where f.run_id=r.run_id) skipped_count,
  (select count(*) from rep q where q.run_id=r.run_id and passed) passed_count, (select count(*) from rep q where q.run_id=r.run_id and not passed) failed_count,
  (select count(*) from entries x where x.run_id=r.run_id) committed_count,
  (select count(*) from rep q where q.run_id=r.run_id and warning_count>0) warning_sample_count,
  (select coalesce(sum(warning_count),0)::bigint from rep q where q.run_id=r.run_id) warning_count,
  case when vs.ok is null then 'none' when vs.ok then 'passed' else 'failed' end verification, vs.good verified_count, vs.bad verify_failure_count
  from runs r left join vs on vs.run_id=r.run_id""")
oracle("completion_stats", f"""{FULL} select r.run_id,
  case when status='committed' then ((60-n%30)*60+30)::double when updated_at_utc is not null then 420::double end elapsed_seconds,
  (select count(*) from entries x where x.run_id=r.run_id) written_count, coalesce(s.warning_count,0) warning_count,
  (select count(*) from fails f where f.run_id=r.run_id) failed_count from runs r left join stages s on s.run_id=r.run_id""")
oracle("run_issues", f"""{FULL}, w as (select run_id, sample_id, warns, unnest(generate_series(0, len(warns)-1)) i from rep where len(warns)>0), x as (select run_id, sample_id, errs, unnest(generate_series(0, len(errs)-1)) i from rep where len(errs)>0)
  select run_id, 'warning' section, 0 section_no, sample_id, i item_no, warns[i+1] message from w
  union all select run_id, 'skipped', 1, sample_id, 0, reason from fails
  union all select run_id, 'failure', 2, sample_id, i, errs[i+1] from x
  union all select run_id, 'verify', 3, sample_id, 0, failure_code from verified where failure_code is not null
  union all select run_id, 'written', 4, sample_id, 0, target_path||' '||target_size from entries""")
FILES = "files as (select 'run'||(doc_id%60) run_id, ['models','runs','temp','venv'][cast(doc_id%4+1 as int)] area, n_chars length from documents)"
INVENTORY = f"with {FILES}, {RUNS}, inv as (select coalesce(f.run_id, r.run_id) run_id, coalesce(r.status,'unknown') status, r.created_at_utc, coalesce(f.b,0) size_bytes, coalesce(f.c,0) file_count from (select run_id, sum(length)::bigint b, count(*) c from files group by 1) f full join runs r on r.run_id=f.run_id)"
oracle("run_inventory", f"{INVENTORY} select *, lower(run_id) run_key from inv")
oracle("inventory_total", f"{INVENTORY} select count(*) run_count, sum(size_bytes)::bigint total_bytes, sum(size_bytes)>5368709120 over_limit from inv")
oracle("usage_by_area", f"with {FILES} select coalesce(area,'(total)') area, sum(length)::bigint size_bytes from files group by rollup(area)")
oracle("resumable_runs", f"with {RUNS} select run_id, status from runs where status is distinct from 'committed'")
oracle("first_failed_samples", f"{ALL} select distinct on (run_id) run_id, sample_id, video_path, array_to_string(errs,'；') reason from rep where not passed order by run_id, sample_id")
oracle("all_failures", f"""{FULL}, {SNAP.replace('with ', '', 1).replace('v as', 'snapv as', 1)}, k as (select a.doc_id//2 sample_id, a.path vp, a.quick vq, b.path tp, b.full_ok tf from snapv a join snapv b on a.doc_id%2=0 and b.doc_id=a.doc_id+1)
  select run_id, sample_id, phase, reason, 'candidate' kind from fails
  union all select run_id, sample_id, 'quality_gate', array_to_string(errs,'|'), 'gate' from rep where not passed
  union all select 'run'||(sample_id%40), sample_id, 'fingerprint', 'video_changed '||vp, 'snapshot' from k where not vq
  union all select 'run'||(sample_id%40), sample_id, 'fingerprint', 'target_changed '||tp, 'snapshot' from k where not tf
  union all select run_id, sample_id, 'verify', failure_code, 'verify' from verified where failure_code is not null""")

# --- event log -----------------------------------------------------------------------------------

oracle("parsed_events", f"{LINES} select * from parsed")
oracle("plain_lines", f"{LINES} select run_id, line_no, plain as value from p where event is null")
oracle("run_progress", f"""{LINES}, tot as (select distinct user_id run_id, case when user_id%10=0 then 0 else 40 end::bigint total, (user_id%100+60)::double el from events),
  st as (select run_id, video_path, count(distinct engine) k from parsed where event='progress' group by 1,2),
  f as (select run_id, count(*) filter (where k=2) completed, sum(k)::bigint steps from st group by 1), g as (select t.run_id, coalesce(completed,0) completed, coalesce(steps,0) steps, total, el from tot t left join f using (run_id))
  select run_id, completed, steps, total, case when total>0 then round_even(steps/80.0::double*100, 0)::bigint else 0 end percent,
  case when steps>0 and total*2>steps then el/steps*(total*2-steps) end remaining_seconds from g""")
LAST = "last as (select run_id, arg_max(reason, line_no) filter (where event='error') error_reason, arg_max(phase, line_no) filter (where event='error') error_phase, arg_max(video_path, line_no) filter (where event='error') error_file, arg_max(path, line_no) filter (where event='run_dir') run_dir, arg_max(index, line_no) filter (where event='progress') done_count, arg_max(total, line_no) filter (where event='progress') total_count, coalesce(bool_or(event='done'), false) done from parsed group by 1)"
oracle("last_events", f"{LINES}, {LAST} select run_id, error_reason, error_phase, run_dir, done_count, total_count, done from last")
ORACLE["transfer_progress"] = " ".join(f"""with l as (select l_suppkey source, l_orderkey+l_linenumber o from lineitem),
  b as (select source, o, cast(round_even((o%97+1+case when o%2=0 then 0.5 else 0 end)::double*{'[1,1024,1048576,1073741824][cast(o%4+1 as int)]'}, 0) as bigint) n from l where o%3<>2),
  f as (select source, coalesce(sum(n) filter (where o%3=0),0)::bigint a, coalesce(max(n) filter (where o%3=1),0) m from b group by 1),
  p as (select s_suppkey source, case when s_suppkey%9=0 then 0 else (s_suppkey%50+1)*10000000000 end total_bytes, s_suppkey%4 component_index, (case when s_suppkey%8=0 then 0 else 5 end)::bigint component_count, (s_suppkey%6)::double el from supplier),
  j as (select p.*, least(total_bytes, greatest(coalesce(a,0), coalesce(m,0))) downloaded_bytes from p left join f using (source)), k as (select *, case when el>=2 and downloaded_bytes>0 then downloaded_bytes/el end speed_bytes from j)
  select source, component_index, component_count, downloaded_bytes, total_bytes, case when component_count>0 then round_even(greatest(0, component_index-1)/component_count::double*100, 0)::bigint else 0 end percent, speed_bytes,
  case when total_bytes>downloaded_bytes then (total_bytes-downloaded_bytes)/speed_bytes end remaining_seconds from k""".split("\n"))
VALUE = """case when event='progress' then '{"event": "progress", "engine": "'||engine||'", "index": '||(e%40)||', '||case when e%3=0 then '"total": "40"' else '"total": 40' end||', "video_path": "'||video||'"}'
  when event='error' then '{"event": "error", "phase": "'||phase||'", "reason": "no '||e||'", "video_path": "'||video||'"}'
  when event='candidate_failed' then '{"event": "candidate_failed", "phase": "'||phase||'", "reason": "skipped", "video_path": "'||video||'", "sample_id": "S'||(e%40)||'"}'
  when event='engine_start' then '{"event": "engine_start", "engine": "'||engine||'", "device": "cpu"}'
  when event='run_dir' then '{"event": "run_dir", "path": "/runs/'||e||'"}' when event='done' then '{"event": "done", "run_dir": "/runs/'||e||'"}' else plain end"""
oracle("failure_reports", f"""{LINES}, {LAST}, out as (select run_id, right(trim(string_agg({VALUE}, chr(10) order by line_no), ' '||chr(10)), 1200) tail from p group by 1)
  select o.run_id, case when error_reason is not null then coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in PHASE_LABELS.items())}}}[error_phase], 'fallback')
    when contains(tail,'质量门禁') then '质量门禁' when contains(tail,'音频提取失败') then '音频提取' when contains(tail,'engine=funasr') or contains(tail,'FunASR') then 'FunASR 转写'
    when contains(tail,'engine=faster-whisper') or contains(tail,'faster-whisper') then 'faster-whisper 转写' when contains(tail,'扫描') then '扫描' else 'fallback' end stage,
  coalesce(error_reason, tail) reason, error_file as file, case when error_reason is not null then run_dir end run_dir,
  case when error_reason is not null then done_count end done_count, case when error_reason is not null then total_count end total_count from out o left join last l using (run_id)""")

# --- streams give what the batch gives -----------------------------------------------------------

for stream, batch in (("streamed_events", "parsed_events"), ("streamed_progress", "run_progress"), ("streamed_status", "last_events")):
    oracle(stream, ORACLE[batch])
oracle("streamed_failures", f"select distinct run_id, sample_id from ({ORACLE['parsed_events']}) where event='candidate_failed'")

BYTES = f"""{LINES}, z as (select run_id, line_no, {VALUE} v from p),
y as (select run_id, line_no old, coalesce(sum(strlen(v)+1) over (partition by run_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint pos from z),
grown as (select parsed.* replace (y.pos as line_no) from parsed join y on parsed.run_id=y.run_id and parsed.line_no=y.old)"""
oracle("growing_events", f"{BYTES} select * from grown")
oracle("ended_runs", f"""{BYTES}, ends as (select run_id, min(line_no) fin from grown where event='done' group by 1),
  r as (select g.*, fin from grown g left join ends using (run_id) where event in ('progress','candidate_failed')),
  seen as (select run_id, video_path, engine, min(line_no) line from r where event='progress' and (fin is null or line_no<fin) group by 1,2,3),
  vid as (select run_id, video_path, count(*) k, max(line) line from seen group by 1,2),
  cnt as (select run_id, count(*) filter (where k=2) completed, sum(k)::bigint steps, max(line) line from vid group by 1)
  select coalesce(c.run_id, e.run_id) run_id, 'progress' kind, coalesce(fin, line) line_no, coalesce(completed,0) completed, coalesce(steps,0) steps, fin is not null done,
    null::varchar sample_id, null::varchar video_path, null::varchar phase, null::varchar reason from cnt c full join ends e using (run_id)
  union all select run_id, 'failure', line_no, null, null, false, sample_id, video_path, phase, reason from r where event='candidate_failed' and (fin is null or line_no<fin)
    qualify row_number() over (partition by run_id, sample_id order by line_no)=1
  union all select run_id, 'late', line_no, null, null, true, sample_id, video_path, phase, reason from r where line_no>fin""")

# --- files read back -----------------------------------------------------------------------------

oracle("listed_media", f"{CATALOG} select distinct m.path, strlen(coalesce(text,''))::bigint length from media m join documents using (doc_id) where m.path not like '%.jpg'")
oracle("listed_texts", "select '/f'||(doc_id%10)||'/clip'||doc_id||'.txt' path, strlen(coalesce(text,''))::bigint length, sha256(coalesce(text,'')) sha256 from documents")
oracle("hashed_files", "select '/f'||(doc_id%7)||'/'||doc_id path, true as exists, strlen(coalesce(text,''))::bigint size, sha256(coalesce(text,'')) sha256 from documents")
oracle("optional_reports", "select '/good'||doc_id||'.json' path, doc_id number, coalesce(text,'') note from documents")
SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)||chr(12288)"
oracle("listed_terms", f"""with l as (select doc_id, regexp_split_to_array(coalesce(text,''), '\\r\\n|\\r|\\n') a from documents),
  n as (select doc_id, unnest(a) line, generate_subscripts(a, 1)+1 line_no from l),
  k as (select doc_id, line_no, string_split(line, ',') a from n where not starts_with(trim(line, {SPACES}), '#')),
  t as (select doc_id, line_no, unnest(a) part, generate_subscripts(a, 1)-1 part_no from k)
  select '/'||doc_id||'.txt' path, line_no::bigint*2147483648+part_no as position, trim(part, {SPACES}) term from t where trim(part, {SPACES})<>''""")
oracle("listed_exclusions", "select '/v/é '||doc_id||'.mp4' video_path from documents union select '/v/é '||(doc_id+1)||'.mp4' from documents")
oracle("stored_captions", ORACLE["caption_digests"])
oracle("caption_range_checks", ORACLE["caption_checks"])
oracle("stored_reports", f"""with {PIECES} select run_id, sample_id, 'candidates' report, case when (sample_id%40)%2=0 then 2*duration_seconds else duration_seconds end duration_seconds, null::varchar reason from cand
  union all select run_id, sample_id, 'failures', null, reason from fails""")

SPLIT = """case when seg_index%12=2 and sample_id%3=0 then chr(4523) when seg_index%12=5 then ''
  else (case when seg_index%4=1 then chr(4449) when seg_index%4=2 then chr(4520) when seg_index%4=3 and sample_id%2=0 then chr(769) else '' end)||text||
  (case when seg_index%4=0 then chr(4370) when seg_index%4=1 and sample_id%3=0 then chr(44032) when seg_index%4=2 then 'e' else '' end) end"""
oracle("joined_text_lengths", f"""with {PIECES}, qa as (select run_id, sample_id, string_agg({norm(f"nfc_normalize({SPLIT})")}, '' order by seg_index) t from prim group by 1,2),
  qb as (select run_id, sample_id, string_agg({SPLIT}, '' order by seg_index) t from sec group by 1,2),
  qx as (select run_id, sample_id, length({cmp('nfc_normalize(qa.t)')})::bigint primary_chars from qa), qy as (select run_id, sample_id, length({cmp('nfc_normalize(qb.t)')})::bigint secondary_chars from qb)
  select coalesce(qx.run_id, qy.run_id) run_id, coalesce(qx.sample_id, qy.sample_id) sample_id, coalesce(primary_chars,0) primary_chars, coalesce(secondary_chars,0) secondary_chars
  from qx full join qy on qx.sample_id=qy.sample_id and qx.run_id=qy.run_id""")

# --- every text in every form --------------------------------------------------------------------

FORMS = "select conv_id, turn, unnest(range(5))::int form, text from conversations"
oracle("raw_form_segments", f"""with c as (select conv_id, turn, form, trim(text, {BLANK}) t from ({FORMS}))
  select conv_id, turn, form, 0::bigint seg_index, 100::bigint start_ms, 2500::bigint end_ms, t text, null::double confidence from c where form in (0,3)
  union all select conv_id, turn, form, 0, 700, 1800, t, 0.25 from c where form=2 union all select conv_id, turn, form, 1, 700, 1800, t, 0.25 from c where form=0
  union all select conv_id, turn, form, 0, 3000, 3500, t, null from c where form=1 union all select conv_id, turn, form, 1, 4000, 4400, 'second', null from c where form=1""")
oracle("raw_form_rejects", f"select conv_id, turn, form, 'no_segments' rejected_reason from ({FORMS}) where form=4")
oracle("document_states", f"""with f as (select doc_id, text, unnest(['own','empty','blank','padded','mark','broken']) form from documents)
  select doc_id, form, case when form in ('own','padded','broken') and text is null then 'missing' when form='broken' then 'nonempty' when form='empty' or form='own' and text='' then 'zero_byte'
  when form in ('blank','mark') or trim(text, {SPACES})='' then 'whitespace_only' else 'nonempty' end state from f""")
