"""Repair of the structure of conversations, by a fold of Spark SQL's higher-order functions.

A repaired conversation's roles are nothing, or an optional system turn and then pairs of user and assistant. Four states tell how
far a prefix has come: nothing yet, after the system turn, after a user, after an assistant. The turns of a conversation become one
sorted array, over which aggregate() carries for every state the cheapest edits so far as a struct (cost, audit); of equal costs the
least audit in ASCII stays, which comparing the structs gives. No Python runs on the executors.

Candidates for one state after the same turns and at the same cost can't be prefixes of each other (the longer one would have more
insertions and so cost more), so what is added later doesn't change their order, and keeping one of them is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What is no visible character.
BLANK = " \t\n\x0b\x0c\r"
#: What the edits and an unmended truncated turn cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns that are folded at a stretch. An audit grows by a character a turn and is copied each time, so stretches are folded apart,
#: from every state, and joined by a second fold.
STRETCH = 256
_FAR = 1 << 40
_STATES = range(4)


def _more(state: Column, cost: int | Column, letter: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit"))


def _only(holds: Column, state: Column) -> Column:
    return F.struct(F.when(holds, state["cost"]).otherwise(F.lit(_FAR).cast("long")).alias("cost"), state["audit"].alias("audit"))


def _four(states: list[Column]) -> Column:
    return F.struct(*(s.alias(f"s{i}") for i, s in enumerate(states)))


def _bind(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with value evaluated once: a lambda's variable is not expanded where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _inserted(c: Column) -> Column:
    """The four states where turns may be inserted after them. More than two in a row never pay."""
    user = _bind(F.least(c["s2"], *(_more(c[s], INSERT, "I") for s in ("s0", "s1", "s3"))), lambda u: F.struct(u.alias("u"), F.least(c["s3"], _more(u, INSERT, "I")).alias("a")))
    return _bind(user, lambda x: _four([c["s0"], c["s1"], x["u"], x["a"]]))


def _step(c: Column, turn: Column) -> Column:
    """The four states after one more turn (i: role's initial, f: its fault)."""
    late = F.when(turn["f"] == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(0))
    stays = ~turn["f"].isin("blank", "duplicate")
    as_role = lambda s, i: _bind(turn["i"] == i, lambda own: F.struct((s["cost"] + late + F.when(own, F.lit(0)).otherwise(F.lit(REROLE))).alias("cost"), F.concat(s["audit"], F.when(own, F.lit("K")).otherwise(F.lit("R"))).alias("audit")))
    gone = [_more(c[f"s{k}"], DELETE, "D") for k in _STATES]
    system = _only(turn["i"] == "s", _more(c["s0"], late, "K"))
    user = F.least(*(as_role(c[s], "u") for s in ("s0", "s1", "s3")))
    kept = _four([gone[0], F.least(gone[1], system), F.least(gone[2], user), F.least(gone[3], as_role(c["s2"], "a"))])
    return _bind(F.when(stays, kept).otherwise(_four(gone)), _inserted)


def _begin(at: Column) -> Column:
    return _four([F.struct(F.when(at == k, F.lit(0)).otherwise(F.lit(_FAR)).cast("long").alias("cost"), F.lit("").alias("audit")) for k in _STATES])


def cheapest(turns: Column) -> Column:
    """Struct (cost, audit) of the cheapest edits of an array of structs (i, f)."""
    some = F.greatest(F.ceil(F.size(turns) / STRETCH).cast("int"), F.lit(1))

    def stretch(b: Column) -> Column:
        rows = F.slice(turns, b * STRETCH + 1, F.lit(STRETCH))
        first = F.array(F.aggregate(rows, _inserted(_begin(F.lit(0))), _step))
        return F.when(b == 0, first).otherwise(F.transform(F.array(*(F.lit(k) for k in _STATES)), lambda k: F.aggregate(rows, _begin(k), _step)))

    def join(c: Column, m: Column) -> Column:
        both = lambda a, b: F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"))
        return _four([F.least(*(both(c[f"s{k}"], F.get(m, F.lit(k))[f"s{t}"]) for k in _STATES)) for t in _STATES])

    folded = F.transform(F.sequence(F.lit(0), some - 1), stretch)
    whole = _bind(folded, lambda m: F.aggregate(F.slice(m, F.lit(2), F.size(m)), F.get(F.get(m, F.lit(0)), F.lit(0)), join))
    return _bind(whole, lambda c: F.least(c["s0"], c["s3"]))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", here: str | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, turns): one row a conversation.

    A turn's first fault counts: blank, then duplicate (its role and text stood earlier), then truncated (the last visible character
    is none of . ! ?). Kept turns cost nothing (audit K), another role 1 (R), deletion 2 (D, which blank and duplicate turns must
    have), an inserted empty user or assistant turn 5 (I), a truncated turn that is not deleted 5 more. illegal counts neighbours
    whose initials are not su, ua or au. turns: the sorted (pos, role, text, fault), for repaired().

    Null roles and texts are one space (no role, blank). Turns stand by number, nulls first, equal ones by role and text; repeated
    rows are duplicates. A null conversation id is one conversation. here: a boolean column; rows where it is false stand only for
    their conversation, which has zeros and an empty audit if it has no other rows. Other columns are not looked at.

    One shuffle, by conversation. A conversation is one row of the outcome, so it has to fit a task.
    """
    t = turns.select(F.col(conv).alias(conv), F.col(turn).alias("_turn"), *(F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(y) for x, y in ((role, "_role"), (text, "_text"))), (F.col(here) if here else F.lit(True)).alias("_here"))
    t = t.withColumn("_turn", F.when(F.col("_here"), F.col("_turn"))).repartition(conv)
    t = t.withColumn("_nth", F.row_number().over(Window.partitionBy(conv, "_here", "_role", "_text").orderBy(F.asc_nulls_first("_turn"))))
    w = Window.partitionBy(conv, "_here").orderBy(F.asc_nulls_first("_turn"), "_role", "_text", "_nth")
    last = F.right(F.rtrim("_text", F.lit(BLANK)), F.lit(1))
    fault = F.when(last == "", "blank").when(F.col("_nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    t = t.select(conv, "_turn", "_role", "_text", "_here", fault.alias("_fault"), F.substring("_role", 1, 1).alias("_i"), F.row_number().over(w).alias("_pos"), F.lag(F.substring("_role", 1, 1)).over(w).alias("_before"), F.lag("_turn").over(w).alias("_last"))
    count = lambda c: F.coalesce(F.sum(F.when(F.col("_here") & c, 1)), F.lit(0)).cast("long")
    new = F.col("_turn").isNotNull() & ~F.col("_turn").eqNullSafe(F.col("_last"))
    pair = F.concat("_before", "_i")
    g = t.groupBy(conv).agg(
        F.coalesce(F.max("_turn") - F.min("_turn") + 1 - count(new), F.lit(0)).cast("long").alias("gaps"),
        *(count(F.col("_fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        count((F.col("_pos") > 1) & ~pair.isin("su", "ua", "au")).alias("illegal"),
        F.sort_array(F.collect_list(F.when(F.col("_here"), F.struct(F.col("_pos").alias("pos"), F.col("_role").alias("role"), F.col("_text").alias("text"), F.col("_fault").alias("fault"))))).alias("turns"),
    )
    brief = F.transform("turns", lambda x: F.struct(F.substring(x["role"], 1, 1).alias("i"), x["fault"].alias("f")))
    g = g.withColumn("_best", cheapest(brief))
    return g.select(conv, "gaps", "blank", "duplicate", "truncated", "illegal", F.col("_best.cost").alias("cost"), F.col("_best.audit").alias("audit"), "turns")


def _pieces(found: DataFrame, conv: str) -> DataFrame:
    """found, with a row for each turn and its edits: pos, and said, the repaired turns (role, text) that come from it.

    The last row of a conversation holds what is inserted after its turns. Roles follow from places: after an optional system turn
    users and assistants alternate. The partitioning by conversation holds, so nothing is shuffled.
    """
    edits = F.concat(F.regexp_extract_all("audit", F.lit("I*[KRD]"), 0), F.array(F.regexp_extract("audit", "I*$", 0)))
    t = found.withColumns({"_edits": edits}).select(*(c for c in found.columns if c != "turns"), F.posexplode(F.arrays_zip("turns", "_edits")).alias("pos", "x"))
    t = t.withColumns({"_own": F.rlike("x._edits", F.lit("[KR]$")), "_extra": F.length(F.regexp_replace("x._edits", "[KRD]", ""))})
    w = Window.partitionBy(conv).orderBy("pos")
    t = t.withColumn("_at", F.sum(F.col("_extra") + F.col("_own").cast("int")).over(w) - F.col("_extra") - F.col("_own").cast("int"))
    opened = (F.col("_at") == 0) & (F.col("_extra") == 0) & F.col("_own") & (F.col("x._edits") == "K") & F.col("x.turns.role").startswith("s")
    t = t.withColumn("_system", F.max(opened.cast("int")).over(w))
    name = lambda at: F.when((at - F.col("_system")) % 2 == 0, "user").otherwise("assistant")
    added = F.transform(F.sequence(F.lit(1), F.col("_extra")), lambda k: F.struct(name(F.col("_at") + k - 1).alias("role"), F.lit("").alias("text")))
    none = F.array().cast("array<struct<role:string,text:string>>")
    own = F.struct(F.when(F.endswith("x._edits", F.lit("K")), F.col("x.turns.role")).otherwise(name(F.col("_at") + F.col("_extra"))).alias("role"), F.col("x.turns.text").alias("text"))
    said = F.concat(F.when(F.col("_extra") > 0, added).otherwise(none), F.when(F.col("_own"), F.array(own)).otherwise(none))
    return t.select(*(c for c in found.columns if c != "turns"), "pos", said.alias("said"))


def repaired(found: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turn, role, text): the repaired turns of repair()'s conversations, numbered from 0. Conversations of which nothing is
    left have no rows."""
    t = _pieces(found, conv).select(conv, "pos", F.posexplode("said").alias("_k", "x"))
    n = F.row_number().over(Window.partitionBy(conv).orderBy("pos", "_k")) - 1
    return t.select(conv, n.cast("long").alias("turn"), "x.role", "x.text")


def digest(found: DataFrame, conv: str = "conv_id") -> DataFrame:
    """found without turns, with repaired_sha256: of the repaired turns as role:text, joined by newlines."""
    lines = F.concat_ws("\n", F.transform("said", lambda x: F.concat(x["role"], F.lit(":"), x["text"])))
    t = _pieces(found, conv).withColumn("line", F.when(F.size("said") > 0, F.struct("pos", lines.alias("line"))))
    kept = [c for c in found.columns if c not in ("turns", conv)]
    t = t.groupBy(conv).agg(*(F.first(c).alias(c) for c in kept), F.sort_array(F.collect_list("line")).alias("lines"))
    return t.select(conv, *kept, F.sha2(F.concat_ws("\n", F.transform("lines", lambda x: x["line"])), 256).alias("repaired_sha256"))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, here): conversations with faults put in by crc32 of `conv_id:turn` modulo 20: 0 drops the turn (here
    is false), 1 empties it, 2 takes away its . ! ?, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(code == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    yes, no = F.lit(True), F.lit(False)
    times = F.when(code == 0, F.array(no)).when(code == 3, F.array(yes, yes)).otherwise(F.array(yes))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("here"))


def op13_structure_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), here="here"))


OP13_SQL = r"""
with recursive c as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') k from conversations),
h as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda x: unicode(x)::bigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 as code from c),
d as (select conv_id, turn, case when code = 4 then 'user' else r end as role, case code when 1 then '' when 2 then regexp_replace(t, '[.!?]', '', 'g') else t end as text, n
  from h, (values (1), (2)) v(n) where code <> 0 and (n = 1 or code = 3)),
e as (select *, row_number() over (partition by conv_id, role, text order by turn nulls first, n) nth, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as final from d),
f as (select *, left(role, 1) i, case when final = '' then 'blank' when nth > 1 then 'duplicate' when final not in ('.', '!', '?') then 'truncated' else '' end as fault,
    row_number() over w pos, lag(left(role, 1)) over w before from e window w as (partition by conv_id order by turn nulls first, role, text, nth)),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate,
    count(*) filter (fault = 'truncated') truncated, count(*) filter (pos > 1 and before || i not in ('su', 'ua', 'au')) illegal, count(*) n from f group by conv_id),
dp as (select conv_id, 0::bigint pos, {'c': 0::bigint, 'a': ''} s0, {'c': 1000000::bigint, 'a': ''} s1, {'c': 5::bigint, 'a': 'I'} s2, {'c': 10::bigint, 'a': 'II'} s3 from (select distinct conv_id from c)
  union all
  select conv_id, pos, n0, n1, m2, least(n3, {'c': m2.c + 5, 'a': m2.a || 'I'}) from (
    select *, least(n2, {'c': n0.c + 5, 'a': n0.a || 'I'}, {'c': n1.c + 5, 'a': n1.a || 'I'}, {'c': n3.c + 5, 'a': n3.a || 'I'}) m2 from (
      select dp.conv_id, f.pos, {'c': s0.c + 2, 'a': s0.a || 'D'} n0,
        least({'c': s1.c + 2, 'a': s1.a || 'D'}, {'c': s0.c + late + case when i = 's' then 0 else 1000000 end, 'a': s0.a || 'K'}) n1,
        least({'c': s2.c + 2, 'a': s2.a || 'D'}, {'c': s0.c + late + uc, 'a': s0.a || u}, {'c': s1.c + late + uc, 'a': s1.a || u}, {'c': s3.c + late + uc, 'a': s3.a || u}) n2,
        least({'c': s3.c + 2, 'a': s3.a || 'D'}, {'c': s2.c + late + ac, 'a': s2.a || a}) n3
      from dp join (select *, case fault when '' then 0 when 'truncated' then 5 else 1000000 end::bigint late, case when i = 'u' then 0 else 1 end uc, case when i = 'u' then 'K' else 'R' end u,
          case when i = 'a' then 0 else 1 end ac, case when i = 'a' then 'K' else 'R' end a from f) f on f.conv_id is not distinct from dp.conv_id and f.pos = dp.pos + 1))),
best as (select dp.conv_id, least(s0, s3) b, gaps, blank, duplicate, truncated, illegal from dp left join counts on counts.conv_id is not distinct from dp.conv_id where dp.pos = coalesce(n, 0)),
ops as (select conv_id, unnest(string_split(b.a, '')) o, generate_subscripts(string_split(b.a, ''), 1) j from best where b.a <> ''),
placed as (select *, count(*) filter (o <> 'I') over (partition by conv_id order by j) pos, count(*) filter (o <> 'D') over (partition by conv_id order by j) e from ops),
said as (select p.conv_id, p.j, p.e, p.o, f.role, f.text, max(case when p.e = 1 and p.o = 'K' and f.i = 's' then 1 else 0 end) over (partition by p.conv_id) opened
  from placed p left join f on p.o <> 'I' and f.conv_id is not distinct from p.conv_id and f.pos = p.pos where p.o <> 'D'),
texts as (select conv_id, string_agg(case when o = 'K' then role when (e - opened) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by j) s from said group by conv_id)
select best.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  b.c cost, b.a audit, sha256(coalesce(s, '')) repaired_sha256
from best left join texts on texts.conv_id is not distinct from best.conv_id
"""
