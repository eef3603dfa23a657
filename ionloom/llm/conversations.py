"""Conversation structure repair by dynamic programming over a trie of signatures.

A conversation's rows in order of turn give its signature, one character a row: the class of its role's initial (s, u, a or
other) and its first fault (none, blank, duplicate or truncated). Counts, cost and the cheapest edits depend on the signature
alone. Signatures are dealt by range and sorted, which is the depth-first order of their prefix trie: each task walks its part
of the trie, computes a layer of the DP once for every prefix that its signatures share, and emits an answer at every terminal
node. Equal signatures, however many, are one node, and their conversations are dealt over tasks by id as well.

Layers hold four states of the pattern (s?(ua)+)? with cost and rank. Ranks order the states' edit strings: those end in the
edit of the same row, so none is the beginning of another, and extending them keeps their order. So ties go to the ASCII-least
string although only one edit a row and state is stored.

Texts take no part until edits are known. Rows are sorted by range of (conversation, turn, role, digest), so a long conversation is read
by many tasks, each of which contributes a piece of the signature (one character a row, as the audit has anyway). Duplicates
are found by aggregation. Only the repaired text of one conversation passes through one task, as a stream of sorted batches:
SHA-256 is defined from beginning to end.

Nulls: a null role or text is one space; null turns come first; a null conv_id is a conversation of its own. Rows of one turn stand
by role and MD5 of the text. An empty role has no legal place. Repeated rows are duplicates. Conversations that have lost all rows
keep a row of zeros; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Characters of a signature by fault, for the role classes s, u, a and other.
CLEAN, TRUNCATED, BLANK, DUPLICATE = "suao", "SUAO", "bcde", "BCDE"
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What an undeleted truncated row adds.
UNFINISHED = 3
SPACE = " \t\n\x0b\f\r"
_OF = {c: (i, fault) for fault in (CLEAN, TRUNCATED, BLANK, DUPLICATE) for i, c in enumerate(fault)}

# States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end.
_AFTER = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}  # by state and class of the row kept
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # by inserting a turn or changing a role
_INSERTS = {0: ((0, 0), (2, 1), (3, 2)), 1: ((1, 0), (2, 1), (3, 2)), 2: ((2, 0), (3, 1)), 3: ((3, 0), (2, 1))}
_START = ((0, 0), None, None, None)


# ---------------------------------------------------------------- the DP


def _reached(layer: tuple) -> dict[int, tuple]:
    """State: (cost, rank, inserts, state inserted from) of its best string, insertions after the last row included."""
    found: dict[int, tuple] = {}
    for p, own in enumerate(layer):
        for s, k in _INSERTS[p] if own else ():
            key = (own[0] + INSERT * k, own[1], "I" * k, p)
            found[s] = min(found.get(s, key), key)
    return found


def _step(layer: tuple, symbol: str) -> tuple[tuple, int, tuple]:
    """The layer after a row of this symbol, with costs above its least one; that least cost; and for each state the one it came from with the edits."""
    role, fault = _OF[symbol]
    more = UNFINISHED if fault == TRUNCATED else 0
    found: dict[int, tuple] = {}
    for s, (cost, rank, word, p) in _reached(layer).items():
        moves = [(s, DELETE, "D")]
        if fault in (CLEAN, TRUNCATED):
            moves.append((_NEXT[s], REROLE + more, "R"))
            if (s, role) in _AFTER:
                moves.append((_AFTER[s, role], KEEP + more, "K"))
        for t, price, edit in moves:
            key = (cost + price, rank, word + edit, p)
            found[t] = min(found.get(t, key), key)
    least = min(k[0] for k in found.values())
    ranks = {k[1:3]: i for i, k in enumerate(sorted(found.values(), key=lambda k: k[1:3]))}
    new = tuple((found[t][0] - least, ranks[found[t][1:3]]) if t in found else None for t in range(4))
    return new, least, tuple((found[t][3], found[t][2]) if t in found else None for t in range(4))


class Trie:
    """A walk through the trie of sorted signatures that keeps the nodes from the root to the current one.

    A node: (layer, cost so far, blank, duplicate, truncated, illegal). Layers are few, up to their common cost, so each is computed once
    for a symbol and then looked up.
    """

    def __init__(self) -> None:
        self.signature, self.found, self.steps = "", None, {}
        self.nodes, self.back = [(_START, 0, 0, 0, 0, 0)], []
        self.layers = 0  # nodes made

    def _down(self, symbol: str, before: str) -> None:
        layer, total, blank, duplicate, truncated, illegal = self.nodes[-1]
        if (layer, symbol) not in self.steps:
            self.steps[layer, symbol] = _step(layer, symbol)
        new, cost, back = self.steps[layer, symbol]
        role, fault = _OF[symbol]
        legal = not before or (_OF[before][0], role) in ((0, 1), (1, 2), (2, 1))
        self.nodes.append((new, total + cost, blank + (fault == BLANK), duplicate + (fault == DUPLICATE), truncated + (fault == TRUNCATED), illegal + (not legal)))
        self.back.append(back)
        self.layers += 1

    def answer(self, signature: str) -> tuple[int, int, int, int, int, str]:
        """(blank, duplicate, truncated, illegal, cost, audit) of a signature; right in any order, cheap in sorted order."""
        if signature != self.signature or self.found is None:
            k, most = 0, min(len(signature), len(self.signature))
            while k < most and signature[k] == self.signature[k]:
                k += 1
            del self.nodes[k + 1 :], self.back[k:]
            for i in range(k, len(signature)):
                self._down(signature[i], signature[i - 1] if i else "")
            layer, total, *counts = self.nodes[-1]
            reached = _reached(layer)
            cost, _, word, p = min(reached[s] for s in (0, 3) if s in reached)
            words = [word]
            for back in reversed(self.back):
                p, word = back[p]
                words.append(word)
            self.signature, self.found = signature, (*counts, total + cost, "".join(reversed(words)))
        return self.found


# ---------------------------------------------------------------- rows and signatures


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that crc32 of conv_id:turn, modulo 20, does: 0 drops a row (copies 0), 1 empties its text, 2 takes out [.!?], 3 repeats it, 4 makes it the user's."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def whole(conversations: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of damaged()."""
    return conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


_ORDER = ("conv_id", "turn", "role", "digest")


def _symbol(fault: str) -> Column:
    role = F.substring("role", 1, 1)
    place = F.when(role == "s", 1).when(role == "u", 2).when(role == "a", 3).otherwise(4)
    return F.substring(F.lit(fault), place, F.lit(1))


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, signature) of every conversation of rows, those without a row left included."""
    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    kind = F.when(shown == "", F.lit("b")).when(F.right(shown, F.lit(1)).isin(".", "!", "?"), F.lit("c")).otherwise(F.lit("t"))
    rows = rows.select("conv_id", "turn", "role", _digest().alias("digest"), kind.alias("kind"), F.col("copies").cast("long").alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.first("kind").alias("kind"), F.sum("copies").alias("n"))
    # the first turn of what stands in several turns; null comes first
    first = F.when(F.count("turn") == F.count("*"), F.min("turn")).alias("first")
    again = rows.where("n > 0 AND kind <> 'b'").groupBy("conv_id", "role", "digest").agg(first, F.count("*").alias("turns")).where("turns > 1")
    own, other = rows.alias("own"), again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first", F.lit(True).alias("many"))
    rows = own.join(other, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce(F.col("many"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    count = F.col("n").cast("int")
    best = F.when(F.col("kind") == "t", _symbol(TRUNCATED)).otherwise(_symbol(CLEAN))
    piece = F.when(count == 0, "").when(F.col("kind") == "b", F.repeat(_symbol(BLANK), count)).when(later, F.repeat(_symbol(DUPLICATE), count)).otherwise(F.concat(best, F.repeat(_symbol(DUPLICATE), count - 1)))
    rows = rows.select("conv_id", "turn", "role", "digest", piece.alias("piece"))
    # a piece of the signature for each conversation and task of the range; ranges are in order
    run = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in _ORDER]).withColumn("task", F.spark_partition_id())
    turn = F.when(F.col("piece") != "", F.col("turn"))
    pieces = run.groupBy("conv_id", "task").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "digest", "piece"))).alias("rows"), F.min(turn).alias("lo"), F.max(turn).alias("hi"), F.count_distinct(turn).alias("turns"))
    pieces = pieces.withColumn("piece", F.array_join(F.col("rows.piece"), ""))
    whole_ = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("task", "piece", "lo", "hi", "turns"))).alias("x"))
    # a turn that goes on in the next task was counted in both
    dated = F.filter("x", lambda p: p["lo"].isNotNull())
    shared = F.aggregate(F.sequence(F.lit(2), F.size(dated)), F.lit(0), lambda a, i: a + F.when(F.element_at(dated, i)["lo"] == F.element_at(dated, i - 1)["hi"], 1).otherwise(0))
    shared = F.when(F.size(dated) > 1, shared).otherwise(0)
    turns = F.aggregate(dated, F.lit(0).cast("long"), lambda a, p: a + p["turns"]) - shared
    gaps = F.array_max("x.hi") - F.array_min("x.lo") + 1 - turns
    return whole_.select("conv_id", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), F.array_join("x.piece", "").alias("signature"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def audits(heads: DataFrame) -> DataFrame:
    """heads (conv_id, gaps, signature) with blank, duplicate, truncated, illegal, cost and audit, from the walk through the trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            found = list(zip(*[trie.answer(s) for s in batch.column(2).to_pylist()], strict=True)) or [()] * 6
            columns = [pa.array(x, pa.int64()) for x in found[:5]] + [pa.array(found[5], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *_COUNTS, "audit"])

    dealt = heads.select("conv_id", "gaps", "signature").repartitionByRange("signature", F.col("conv_id").asc_nulls_first()).sortWithinPartitions("signature")
    return dealt.mapInArrow(run, f"conv_id {heads.schema['conv_id'].dataType.simpleString()}, gaps long, signature string, {', '.join(f'{c} long' for c in _COUNTS)}, audit string")


# ---------------------------------------------------------------- repair


def repaired(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(conv_id, position, edit, fault, role, text): all edits of each conversation in order, deleted rows (edit D) with their old role and inserted ones (I) included. The rows of a conversation follow each other in one partition.

    heads is what audits() gave of the same rows. It is streamed: a task holds one batch of rows and one audit.
    """
    none = lambda kind: F.lit(None).cast(kind)
    kind = rows.schema["conv_id"].dataType.simpleString()
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("part"), "turn", "role", _digest().alias("digest"), "text", F.col("copies").cast("long").alias("copies"), none("string").alias("signature"))
    head = heads.select("conv_id", F.lit(0).alias("part"), none(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), none("binary").alias("digest"), F.col("audit").alias("text"), none("long").alias("copies"), "signature")
    order = ["conv_id", "part", "turn", "role", "digest"]
    stream = body.unionByName(head).repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    names = ["conv_id", "position", "edit", "fault", "role", "text"]
    types = f"conv_id {kind}, position long, edit string, fault string, role string, text string"
    faults = {c: name for name, symbols in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)) for c in symbols}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, signature, at, row, state, position = "", "", 0, 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            own = batch.select(["conv_id", "part", "role", "text", "copies", "signature"])

            def put(conv, edit, fault, role, text, out=out):
                nonlocal position
                out.append((conv, position, edit, fault, role, text))
                position += 1

            def insert(conv):
                nonlocal at, state
                while at < len(audit) and audit[at] == "I":
                    state = _NEXT[state]
                    put(conv, "I", None, "user" if state == 2 else "assistant", "")
                    at += 1

            for conv, part, role, text, copies, word in zip(*[c.to_pylist() for c in own.columns], strict=True):
                if part == 0:
                    audit, signature, at, row, state, position = text, word, 0, 0, 0, 0
                for _ in range(copies or 0):
                    edit, symbol = audit[at], signature[row]
                    at, row = at + 1, row + 1
                    if edit == "K":
                        state = _AFTER[state, _OF[symbol][0]]
                    elif edit == "R":
                        state = _NEXT[state]
                        role = "user" if state == 2 else "assistant"
                    put(conv, edit, faults.get(symbol), role, text)
                    insert(conv)  # those that follow this row
                if part == 0:
                    insert(conv)  # those before the first row
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [()] * 6, [batch.schema.field("conv_id").type, pa.int64(), *[pa.string()] * 4], strict=True)], names=names)

    return stream.mapInArrow(run, types)


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations with an edit; edits is repaired()'s own result, so a conversation's rows follow each other."""
    kind = edits.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, lines = None, None, 0
        for batch in batches:
            done = []
            for conv, position, edit, role, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)], strict=True):
                if position == 0:
                    if sha:
                        done.append((current, sha.hexdigest()))
                    current, sha, lines = conv, hashlib.sha256(), 0
                if edit != "D":
                    sha.update((("\n" if lines else "") + f"{role}:{text}").encode())
                    lines += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field(0).type), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])
        if sha:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "repaired_sha256": sha.hexdigest()}], pa.schema([("conv_id", batch.schema.field(0).type), ("repaired_sha256", pa.string())]))

    return edits.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """The conversations repaired at least cost: conv_id, position, role and text of the rows that stay or come in."""
    rows = whole(conversations)
    heads = cut(audits(signatures(rows)), "conversations-audits")
    return repaired(rows, heads).where("edit <> 'D'").select("conv_id", "position", "edit", "role", "text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    heads = cut(audits(signatures(rows)), "conversations-audits")
    found = digests(repaired(rows, heads)).withColumnRenamed("conv_id", "own")
    empty = hashlib.sha256().hexdigest()
    out = heads.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    return out.select("conv_id", "gaps", *_COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}

_EDGE = r"[^\x20\x09-\x0D]"

ORACLE = {
    "op11_conversation_repair": rf"""
WITH RECURSIVE e(i, k, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM e WHERE k < 8),
 tab AS (SELECT list(v ORDER BY i) AS t FROM e WHERE k = 8),
 o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
   lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]), 4294967295), 4294967295) % 20 AS code FROM conversations, tab),
 d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM o),
 n AS (SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
 f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{_EDGE}') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN '' ELSE 't' END AS fault,
   CASE WHEN i > 1 AND lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS odd FROM n),
 a AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, sum(odd) AS illegal FROM f GROUP BY conv_id),
 h AS (SELECT DISTINCT conv_id FROM conversations),
 mv(p, s, word, price, lines) AS (VALUES (0, 0, '', 0, CAST([] AS VARCHAR[])), (0, 2, 'I', 3, ['user:']), (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 1, '', 0, []), (1, 2, 'I', 3, ['user:']), (1, 3, 'II', 6, ['user:', 'assistant:']), (2, 2, '', 0, []), (2, 3, 'I', 3, ['assistant:']), (3, 3, '', 0, []), (3, 2, 'I', 3, ['user:'])),
 ed(s, edit, c, z) AS (VALUES (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2), (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3)),
 dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM h
  UNION ALL
  SELECT conv_id, i, z, min({{'c': cost, 'a': audit}}).c, min({{'c': cost, 'a': audit}}).a, arg_min(lines, {{'c': cost, 'a': audit}}) FROM (
   SELECT dp.conv_id, dp.i + 1 AS i, ed.z, dp.cost + mv.price + CASE ed.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN ed.edit <> 'D' AND f.fault = 't' THEN 3 ELSE 0 END AS cost, dp.audit || mv.word || ed.edit AS audit,
    dp.lines || mv.lines || CASE ed.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE ed.z WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END AS lines
   FROM dp JOIN mv ON mv.p = dp.s JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ed ON ed.s = mv.s AND (ed.c IS NULL OR ed.c = f.c) AND (ed.edit = 'D' OR f.fault NOT IN ('b', 'd'))) GROUP BY conv_id, i, z),
 en AS (SELECT dp.conv_id, min({{'c': dp.cost + mv.price, 'a': dp.audit || mv.word}}) AS best, arg_min(dp.lines || mv.lines, {{'c': dp.cost + mv.price, 'a': dp.audit || mv.word}}) AS lines
  FROM dp LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM dp.conv_id JOIN mv ON mv.p = dp.s AND mv.s IN (0, 3) WHERE dp.i = coalesce(a.n, 0) GROUP BY dp.conv_id)
SELECT en.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
 CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM en LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM en.conv_id
"""
}
