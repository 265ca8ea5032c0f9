"""Repair of conversation structure at least cost.

Each row of a conversation becomes a symbol: who speaks (s, u, a, o for other; a capital letter if the text is
truncated), or B for a blank row and D for a duplicate.  Edits of a row (keep, rerole, delete) and inserts before
it are moves between four states of what stands so far: nothing, a system turn, a user's turn last, an
assistant's last.  A symbol thus has a 4 x 4 matrix over (cost, audit), and a run of symbols the min-plus product.

Method.  Re-Pair: the most frequent neighbouring pairs of the distinct symbol sequences become rules, a few for
each counting pass over all of them; a rule's matrix is the product of its two symbols' and is evaluated once,
bottom-up, its audits as ropes that share those of its parts.  The grammar, at most ``rounds * rules`` rules, is
then shared by all conversations: each is rewritten to grammar symbols and walked with a vector of four states.
Every audit ends in a row's letter, so none of two audits of the same rows is the other's prefix: where costs tie,
the order of the prefixes decides before that of the next piece, and no long audit is compared again.

Scale.  Rows are shuffled once, by ranges of (conversation, turn, role), and leave each range as segments of
bounded rows and bytes.  Conversations within one range are finished where their segment is read; those on the
border of two ranges, or longer than a segment, are walked over their symbols alone, their audits cut by segment,
and their texts then go through the digest segment by segment in order, as a digest is a chain.

Defined cases.  A null role or text is one space; null ids form one conversation, null turns come first.  Rows of
one turn are taken by role, then text; repeated rows are duplicates.  A conversation without live rows has zeros,
an empty audit and the digest of ''.  Further columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import Memo
from lodestone.llm.shared import stored, table

SYMBOLS = "suaoSUAOBD"
START, SYSTEM, USER, ASSISTANT = range(4)
RULE, TRUNCATED = 0x100, 3  # code point of the first rule; what an undeleted truncated row adds
REROLE, DELETE, INSERT = 3, 4, 3
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Rope:
    """Text made of two ropes, or a piece; flattened when asked for."""

    __slots__ = ("left", "right", "flat")

    def __init__(self, left, right=None):
        self.left, self.right, self.flat = left, right, left if right is None else None

    def text(self) -> str:
        if self.flat is None:
            out, stack = [], [self]
            while stack:
                r = stack.pop()
                if r.flat is not None:
                    out.append(r.flat)
                else:
                    stack += (r.right, r.left)
            self.flat = "".join(out)
        return self.flat


Matrix = list[list[tuple[int, Rope] | None]]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Least (cost, audit) of going from state i to j by a, then b."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            for k in range(4):
                if a[i][k] and b[k][j]:
                    cost, rope = a[i][k][0] + b[k][j][0], Rope(a[i][k][1], b[k][j][1])
                    best = out[i][j]
                    if best is None or cost < best[0] or cost == best[0] and rope.text() < best[1].text():
                        out[i][j] = (cost, rope)
    return out


def _matrix(moves: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return [[(m[0], Rope(m[1])) if (m := moves.get((i, j))) else None for j in range(4)] for i in range(4)]


SPOKEN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # who can be inserted, or reroled to, in a state
INSERTS = _matrix({(i, i): (0, "") for i in range(4)} | {(i, j): (INSERT, "I") for i, j in SPOKEN.items()} | {(i, ASSISTANT): (2 * INSERT, "II") for i in (START, SYSTEM)})
LAST = {START: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}


def of_symbol(symbol: str) -> Matrix:
    moves = {(i, i): (DELETE, "D") for i in range(4)}
    if symbol not in "BD":
        more, who = TRUNCATED * symbol.isupper(), symbol.lower()
        moves |= {(i, j): (REROLE + more, "R") for i, j in SPOKEN.items()}
        kept = {"s": {START: SYSTEM}, "u": {i: USER for i in (START, SYSTEM, ASSISTANT)}, "a": {USER: ASSISTANT}}.get(who, {})
        moves |= {(i, j): (more, "K") for i, j in kept.items()}
    return product(INSERTS, _matrix(moves))


@dataclass
class Grammar:
    """Rules in order: each turns a pair of symbols into a new one."""

    pairs: list[str] = field(default_factory=list)

    def rewrite(self, symbols: str) -> str:
        for k, pair in enumerate(self.pairs):
            symbols = symbols.replace(pair, chr(RULE + k))
        return symbols

    def matrices(self) -> dict[str, Matrix]:
        """The matrix of each symbol and rule, bottom-up."""
        found = {x: of_symbol(x) for x in SYMBOLS}
        for k, (a, b) in enumerate(self.pairs):
            found[chr(RULE + k)] = product(found[a], found[b])
        return found


def learn(sequences: DataFrame, rounds: int = 5, rules: int = 12) -> Grammar:
    """Rules for the sequences(symbols, n): each round counts all neighbouring pairs and takes the most frequent."""
    grammar = Grammar()
    for _ in range(rounds):

        def pairs(batches: Iterator[pa.RecordBatch], known: Grammar = grammar) -> Iterator[pa.RecordBatch]:
            total: Counter[str] = Counter()
            for b in batches:
                for symbols, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = known.rewrite(symbols)
                    for i in range(len(x) - 1):
                        total[x[i : i + 2]] += n
            yield pa.record_batch({"pair": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

        found = sequences.select("symbols", "n").mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        best = [r.pair for r in found.orderBy(F.desc("n"), "pair").limit(rules).collect()]
        if not best:
            break
        grammar = Grammar(grammar.pairs + best)
    return grammar


class Walker:
    """Cheapest audits, by one grammar; those of short sequences are kept in a memo."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.steps = {x: [(i, j, m[i][j][0], m[i][j][1].text()) for i in range(4) for j in range(4) if m[i][j]] for x, m in grammar.matrices().items()}
        self.audits = Memo(lambda symbols: self.cut([symbols])[0])

    def cut(self, segments: list[str]) -> list[str]:
        """The cheapest audit of the segments' symbols together, cut at their borders; inserts after the last row are the last's."""
        vector: list = [(0, 0, None)] + [None] * 3  # by state: cost, place of the audit among the four, chain of pieces
        lengths = []
        for symbols in segments:
            rewritten = self.grammar.rewrite(symbols)
            lengths.append(len(rewritten))
            for x in rewritten:
                best: list = [None] * 4
                for i, j, cost, piece in self.steps[x]:
                    if v := vector[i]:
                        key = (v[0] + cost, v[1], piece, i)
                        if best[j] is None or key < best[j]:
                            best[j] = key
                order = {key: k for k, key in enumerate(sorted({b[1:3] for b in best if b}))}
                vector = [b and (b[0], order[b[1:3]], (vector[b[3]][2], b[2])) for b in best]
        cost, place, tail, chain = min((v[0] + LAST[j][0], v[1], LAST[j][1], v[2]) for j, v in enumerate(vector) if v)
        pieces = []
        while chain:
            chain, piece = chain
            pieces.append(piece)
        pieces.reverse()
        out, at = [], 0
        for n in lengths:
            out.append("".join(pieces[at : at + n]))
            at += n
        out[-1] += tail
        return out


class Repairing:
    """Takes the segments of one conversation in order and holds its report so far."""

    def __init__(self):
        self.state, self.initial, self.digest, self.any = START, None, hashlib.sha256(), False
        self.lo = self.hi = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []

    def take(self, symbols: str, audit: str, roles: list[str], texts: list[str], turns: tuple) -> Iterator[tuple[str, str]]:
        """Adds a segment; gives its repaired turns.  turns: first, last and number of distinct ones, nulls apart."""
        first, last, n = turns
        if n:
            self.turns += n - (self.last_turn == first)
            self.lo, self.hi, self.last_turn = first if self.lo is None else self.lo, last, last
        self.blank += symbols.count("B")
        self.duplicate += symbols.count("D")
        self.truncated += sum(map(symbols.count, "SUAO"))
        self.audit.append(audit)
        for role in roles:
            self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
            self.initial = role[:1]
        row = 0
        for letter in audit:
            name, text = "assistant" if self.state == USER else "user", ""
            if letter == "I":
                self.cost += INSERT
            else:
                if letter == "D":
                    self.cost += DELETE
                    row += 1
                    continue
                self.cost += REROLE * (letter == "R") + TRUNCATED * symbols[row].isupper()
                name, text = roles[row] if letter == "K" else name, texts[row]
                row += 1
            self.state = SYSTEM if letter == "K" and name[:1] == "s" else SPOKEN[self.state]
            self.digest.update((("\n" if self.any else "") + name + ":" + text).encode())
            self.any = True
            yield name, text

    def report(self) -> tuple:
        gaps = self.hi - self.lo + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def segments(rows: DataFrame, dropped: str | None = None, most_rows: int = 4096, most_bytes: int = 4 << 20) -> DataFrame:
    """rows(conv_id, turn, role, text) in order, as segments of at most so many rows and about so many bytes.

    sid is in the order of conversations and turns; edge tells that the conversation may go on in another segment,
    and only then has ``seen`` digests of its rows.  Rows whose column ``dropped`` is true only keep their
    conversation in the result."""
    role, text, gone = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.col(dropped) if dropped else F.lit(False)
    blank, ended = ~text.rlike(r"[^\x20\x09-\x0D]"), text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(gone, "gone").when(blank, "B").when(ended, "whole").otherwise("cut")
    read = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.when(gone, "").otherwise(text).alias("text"), fault.alias("fault"))
    read = read.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, runs = TaskContext.get().partitionId() << 32, 0
        fresh = lambda: {"symbols": [], "roles": [], "texts": [], "seen": [], "first": None, "last": None, "n": 0}
        conv, held, known, size, split = None, None, set(), 0, False

        done, waiting = [], 0

        def flush(edge: bool, now: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal sid, done, waiting
            sid += 1
            done.append({**held, "symbols": "".join(held["symbols"]), "seen": held["seen"] if edge else None, "conv_id": conv, "sid": sid, "edge": edge})
            waiting += size
            if now or waiting >= most_bytes or len(done) >= 500:
                yield pa.RecordBatch.from_pylist(done, schema=made)
                done, waiting = [], 0

        for b in batches:
            made = pa.schema([("sid", pa.int64()), ("conv_id", b.schema.field(0).type), ("edge", pa.bool_()), ("symbols", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("seen", pa.list_(pa.binary()))])
            for c, turn, name, words, what in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if held is None or c != conv:
                    if held is not None:
                        yield from flush(runs == 1 or split)
                    conv, held, known, size, split, runs = c, fresh(), set(), 0, False, runs + 1
                elif len(held["roles"]) >= most_rows or size >= most_bytes:
                    split = True
                    yield from flush(True)
                    held, size = fresh(), 0
                if what == "gone":
                    continue
                who = name[:1] if name[:1] in ("s", "u", "a") else "o"
                mark = None
                if what != "B":
                    mark = hashlib.blake2b(f"{len(name)}:{name}{words}".encode(), digest_size=16).digest()
                    if mark in known:
                        mark, what = None, "D"
                    else:
                        known.add(mark)
                held["symbols"].append(what if what in ("B", "D") else who if what == "whole" else who.upper())
                held["roles"].append(name)
                held["texts"].append(words)
                held["seen"].append(mark)
                size += len(words)
                if turn is not None:
                    held["n"] += held["last"] != turn
                    held["first"], held["last"] = turn if held["first"] is None else held["first"], turn
        if held is not None:
            yield from flush(True, True)

    out = f"sid long, conv_id {kind}, edge boolean, symbols string, first long, last long, n long, roles array<string>, texts array<string>, seen array<binary>"
    return read.mapInArrow(run, out)


def _audited(edges: DataFrame, grammar: Grammar) -> DataFrame:
    """sid, symbols, audit of edges(sid, conv_id, symbols, seen): duplicates across segments marked, audits cut by segment."""
    each = edges.select("conv_id", "sid", F.posexplode("seen").alias("pos", "mark")).where("mark is not null")
    again = each.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "mark").orderBy("sid", "pos"))).where("nth > 1")
    whole = edges.select("conv_id", "sid", "symbols").join(again.groupBy("sid").agg(F.collect_list("pos").alias("again")), "sid", "left").select("conv_id", "sid", "symbols", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, conv, ids, seqs = Walker(grammar), None, [], []

        def done() -> pa.RecordBatch:
            return pa.record_batch({"sid": pa.array(ids, pa.int64()), "symbols": pa.array(seqs, pa.string()), "audit": pa.array(walker.cut(seqs), pa.string())})

        for b in batches:
            for c, sid, symbols, places in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if ids and c != conv:
                    yield done()
                    ids, seqs = [], []
                letters = list(symbols)
                for k in places or ():
                    letters[k] = "D"
                conv = c
                ids.append(sid)
                seqs.append("".join(letters))
        if ids:
            yield done()

    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "sid").mapInArrow(run, "sid long, symbols string, audit string")


def _told(parts: DataFrame, grammar: Grammar, turns: bool) -> DataFrame:
    """Reports, or repaired turns, of parts(conv_id, symbols, audit, roles, texts, first, last, n) in order; a null audit is found here."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, conv, held, position = Walker(grammar), None, None, 0
        names = ["conv_id"] + ([] if turns else [x.split()[0] for x in REPORT.split(", ")])
        for b in batches:
            key, out = b.schema.field(0).type, []
            for c, symbols, audit, roles, texts, first, last, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if held is None or c != conv:
                    if held is not None and not turns:
                        out.append((conv, *held.report()))
                    conv, held, position = c, Repairing(), 0
                for name, text in held.take(symbols, walker.audits[symbols] if audit is None else audit, roles, texts, (first, last, n)):
                    if turns:
                        out.append((c, position, name, text))
                        position += 1
            yield _rows(out, ["conv_id", "position", "role", "text"] if turns else names, key)
        if held is not None and not turns:
            yield _rows([(conv, *held.report())], names, key)

    return parts.select("conv_id", "symbols", "audit", "roles", "texts", "first", "last", "n").mapInArrow(run, f"conv_id {kind}, " + ("position long, role string, text string" if turns else REPORT))


def _rows(rows: list[tuple], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    kinds = {"audit": pa.string(), "repaired_sha256": pa.string(), "role": pa.string(), "text": pa.string(), "conv_id": key}
    columns: Iterable = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names)


def repair(rows: DataFrame, dropped: str | None = None, turns: bool = False, rounds: int = 5, rules: int = 12, most_rows: int = 4096, most_bytes: int = 4 << 20) -> DataFrame:
    """One report for each conversation of rows(conv_id, turn, role, text): conv_id and REPORT; with ``turns``, the
    repaired conversations instead: conv_id, position, role, text."""
    parts = stored(segments(rows, dropped, most_rows, most_bytes), "segments")
    sequences = stored(parts.where("symbols <> ''").groupBy("symbols").agg(F.count("*").alias("n")), "sequences")
    grammar = learn(sequences, rounds, rules)
    edges = parts.where("edge")
    cut = _audited(edges, grammar)
    bordering = edges.drop("symbols").join(cut, "sid").repartition("conv_id").sortWithinPartitions("conv_id", "sid")
    inner = parts.where("not edge").withColumn("audit", F.lit(None).cast("string"))
    return _told(inner, grammar, turns).unionByName(_told(bordering, grammar, turns))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with faults put in by the crc32 of 'conv_id:turn' modulo 20: 0 drops the
    row (``dropped``), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.  Nulls are a space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(hit == 4, "user").otherwise(part("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (hit == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(hit == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), "dropped")


def oracle() -> str:
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    word = r"[^\x20\x09-\x0D]"
    return f"""with recursive tab as (select list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
d0 as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') txt, xor(list_reduce([4294967295::bigint] || list_transform(string_split({key}, ''), lambda c: ascii(c)::bigint), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 20 hit from conversations, tab),
d1 as (select conv_id, turn, case when hit = 4 then 'user' else role end role, case when hit = 1 then '' when hit = 2 then translate(txt, '.!?', '') else txt end txt, unnest(case when hit = 3 then [1, 2] else [1] end) from d0 where hit <> 0),
d2 as (select conv_id, turn, role, txt, row_number() over (partition by conv_id order by turn nulls first, role, txt) k, substr(role, 1, 1) ini, not regexp_matches(txt, '{word}') blank, regexp_matches(txt, '[.!?][\\x20\\x09-\\x0D]*\\z') ended from d1),
d3 as (select *, not blank and nth > 1 dup, not blank and nth = 1 and not ended cut, lag(ini) over (partition by conv_id order by k) was from (select *, row_number() over (partition by conv_id, role, txt order by k) nth from d2)),
stats as (select conv_id, case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end gaps, count(*) filter (blank) blank, count(*) filter (dup) duplicate, count(*) filter (cut) truncated, count(*) filter (was is not null and was || ini not in ('su', 'ua', 'au')) illegal, max(k) n from d3 group by 1),
ins as (select * from (values (0, 0, '', []::varchar[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])) x(f, m, pre, put)),
act as (select * from (values (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'), (0, 2, 'R', ''), (1, 2, 'R', ''), (3, 2, 'R', ''), (2, 3, 'R', ''), (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', '')) x(m, t, edit, needs)),
moves as (select f, t, needs, edit, pre || edit step, put, 3 * length(pre) + case edit when 'K' then 0 when 'R' then 3 else 4 end price from ins join act using (m)),
walk as (select conv_id, 0::bigint k, 0 s, 0::bigint cost, '' audit, []::varchar[] said from stats
  union all select conv_id, k, t, (b).cost, (b).audit, (b).said from (select conv_id, k, t, min(struct_pack(cost := cost, audit := audit, said := said)) b from (select w.conv_id, w.k + 1 k, m.t, w.cost + price + case when cut and edit <> 'D' then 3 else 0 end cost, audit || step audit,
      said || put || case edit when 'D' then [] when 'K' then [role || ':' || txt] else [case t when 2 then 'user:' else 'assistant:' end || txt] end said
    from walk w join d3 r on r.conv_id is not distinct from w.conv_id and r.k = w.k + 1 join moves m on m.f = w.s and (edit = 'D' or not blank and not dup) and (edit <> 'K' or ini = needs)) group by all)),
fin as (select w.conv_id, min(struct_pack(cost := cost + 3 * length(tail), audit := audit || tail, said := said || put)) b from walk w join stats g on g.conv_id is not distinct from w.conv_id and g.n = w.k join (values (0, '', []::varchar[]), (3, '', []), (2, 'I', ['assistant:']), (1, 'II', ['user:', 'assistant:'])) e(s, tail, put) using (s) group by 1)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce((b).cost, 0)::bigint as cost, coalesce((b).audit, '') as audit, sha256(coalesce(array_to_string((b).said, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join stats g on g.conv_id is not distinct from c.conv_id left join fin f on f.conv_id is not distinct from c.conv_id"""
