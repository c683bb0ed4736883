"""Conversation structure repair by cheapest edits (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.text import BLANKS, WORD, whole

# Costs, fixed values: roles of a repaired conversation read (s?(ua)+)?.
RENAME, DROP, ADD, CUT_OFF = 2, 3, 2, 1
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What has been written so far: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: A kept role leads on by its initial; a renamed or added turn takes the one role that fits.
KEEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
FITS = ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Nodes above which prefixes that all candidates share are written out. Base and modulus of the hashes.
NODES, BASE, MODULUS = 1 << 14, 1_000_003, (1 << 61) - 1


class Audits:
    """Edit lists as linked nodes that share their prefixes.

    A node knows its edit, length, the hash of all its edits and its ancestors 1, 2, 4, ... edits back.
    """

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.op, self.length, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, parent: int, op: str) -> int:
        new, up, k = len(self.op), [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.op.append(op)
        self.length.append(self.length[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(op)) % self.modulus)
        self.up.append(up)
        return new

    def back_to(self, node: int, length: int) -> int:
        """The ancestor with so many edits."""
        steps = self.length[node] - length
        while steps:
            k = steps.bit_length() - 1
            node, steps = self.up[node][k], steps - (1 << k)
        return node

    def edits(self, node: int, above: int = 0) -> str:
        out = []
        while node != above:
            out.append(self.op[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _alike(self, a: int, b: int) -> bool:
        """Whether two nodes of one length and hash have the same edits; walks to where they meet."""
        while a != b:
            if self.op[a] != self.op[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def before(self, a: int, x: str, b: int, y: str) -> bool:
        """Whether the edits of a and then x come before those of b and then y, by ASCII.

        The longest common prefix is found by halving on the hashes of ancestors, then checked edit by edit.
        """
        short = min(self.length[a], self.length[b])
        p, q = self.back_to(a, short), self.back_to(b, short)
        if self.hash[p] == self.hash[q]:
            if self._alike(p, q):
                left = x if self.length[a] == short else self.op[self.back_to(a, short + 1)]
                right = y if self.length[b] == short else self.op[self.back_to(b, short + 1)]
                if left != right:
                    return left < right
        else:
            for k in range(len(self.up[p]) - 1, -1, -1):
                if k < len(self.up[p]) and self.hash[self.up[p][k]] != self.hash[self.up[q][k]]:
                    p, q = self.up[p][k], self.up[q][k]
            if self._alike(self.up[p][0], self.up[q][0]):
                return self.op[p] < self.op[q]
        return self.edits(a) + x < self.edits(b) + y  # two hashes met, or one list begins the other

    def shared(self, nodes: list[int]) -> int:
        """The last node that all come from."""
        short = min(self.length[n] for n in nodes)
        now = {self.back_to(n, short) for n in nodes}
        while len(now) > 1:
            first = next(iter(now))
            for k in range(len(self.up[first]) - 1, -1, -1):
                if len({self.up[n][k] for n in now}) > 1:
                    now = {self.up[n][k] for n in now}
                    break
            else:
                now = {self.up[n][0] for n in now}
        return now.pop()


class Repair:
    """Dynamic program over the rows of one conversation: for each of the four states the cheapest edits that lead there.

    Of equal costs the ASCII-least edits win. That may be decided at once: at one row and state no edits of one cost begin
    others, as only added turns could follow, which cost. The text that an entry has written is held as its running
    SHA-256, so rows pass by one after the other.
    """

    def __init__(self, modulus: int = MODULUS, nodes: int = NODES):
        self.audits, self.done, self.limit, self.nodes = Audits(modulus), "", nodes, nodes
        self.states = [(0, 0, hashlib.sha256()), None, None, None]  # cost, node, hash of the text
        self._added()

    def _best(self, ways: list[tuple]) -> tuple | None:
        """Cheapest of (cost, node, edit, hash, written)."""
        best = None
        for way in ways:
            if best is None or way[0] < best[0] or way[0] == best[0] and self.audits.before(way[1], way[2], best[1], best[2]):
                best = way
        return best

    def _entry(self, way: tuple | None, first: bool) -> tuple | None:
        if way is None:
            return None
        cost, node, edit, text, written = way
        if written is not None:
            text = text.copy()
            text.update(written if first else b"\n" + written)
        return cost, self.audits.add(node, edit), text

    def _added(self) -> None:
        """Adds a user turn where one fits, then an assistant turn; more never pays."""
        for to in (USER, ASSISTANT):
            now = self.states[to]
            for fro, into in FITS:
                old = self.states[fro]
                if into == to and old and (now is None or old[0] + ADD <= now[0]):
                    node, edit = (now[1], "") if now else (0, "")
                    if now is None or old[0] + ADD < now[0] or self.audits.before(old[1], "I", node, edit):
                        way = (old[0] + ADD, old[1], "I", old[2], f"{NAMES[to]}:".encode())
                        now = self._entry(way, fro == START)
            self.states[to] = now

    def row(self, role: str, text: str, fault: int) -> None:
        ways = [[] for _ in range(4)]
        for s, old in enumerate(self.states):
            if old:
                ways[s].append((old[0] + DROP, old[1], "D", old[2], None, s))
        if fault not in (BLANK, DUPLICATE):
            extra = CUT_OFF if fault == TRUNCATED else 0
            body = text.encode("utf-8", "surrogatepass")
            for edit, steps in (("K", KEEPS.get(role[:1], ())), ("R", FITS)):
                for fro, to in steps:
                    old = self.states[fro]
                    if old:
                        name = role if edit == "K" else NAMES[to]
                        cost = old[0] + extra + (RENAME if edit == "R" else 0)
                        ways[to].append((cost, old[1], edit, old[2], name.encode("utf-8", "surrogatepass") + b":" + body, fro))
        best = [self._best(w) for w in ways]
        self.states = [b and self._entry(b[:5], b[5] == START) for b in best]
        self._added()
        if len(self.audits.op) > self.limit:
            self._write_out()

    def _write_out(self) -> None:
        """What all entries share is decided: it leaves the nodes, and so do those that nothing leads to any more."""
        old, live = self.audits, [e for e in self.states if e]
        root = old.shared([e[1] for e in live])
        self.done += old.edits(root)
        self.audits, moved = Audits(old.modulus), {root: 0}
        for e in live:
            path, node = [], e[1]
            while node not in moved:
                path.append(node)
                node = old.up[node][0]
            for n in reversed(path):
                moved[n] = self.audits.add(moved[old.up[n][0]], old.op[n])
        self.states = [e and (e[0], moved[e[1]], e[2]) for e in self.states]
        self.limit = max(self.nodes, 2 * len(self.audits.op))

    def result(self) -> tuple[int, str, str]:
        """(cost, edits, SHA-256 of the repaired text)."""
        cost, node, _, text, _ = self._best([(e[0], e[1], "", e[2], None) for e in (self.states[START], self.states[ASSISTANT]) if e])
        return cost, self.done + self.audits.edits(node), text.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with faults that crc32 of ``conv_id:turn`` deals, modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets role user. A null is one space, but a null
    turn stays null.
    """
    blank = lambda c: F.coalesce(c, F.lit(" "))
    key = F.concat(blank(F.col("conv_id").cast("string")), F.lit(":"), blank(F.col("turn").cast("string")))
    kind = F.crc32(key) % 20
    text, role = blank(F.col("text")), blank(F.col("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), kind.alias("_kind"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return out.where("_kind > 0").withColumn("_copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def _ordered() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def faults(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with the first fault of each: blank, a repeat of an earlier role and text, or cut off."""
    alike = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    fault = (F.when(~F.col("text").rlike(WORD), BLANK).when(F.row_number().over(alike) > 1, DUPLICATE)
             .when(~F.col("text").rlike(f"[.!?](?:{BLANKS})?\\z"), TRUNCATED).otherwise(FINE))
    return rows.withColumn("fault", fault.cast("int"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

    rows(conv_id, turn, role, text) count in the order of turn, null first, then role and text. The audit lists the cheapest
    edits: K keeps a row, R gives it the role that fits, D deletes it, I adds an empty turn. Kept and renamed rows and added
    turns then read (s?(ua)+)? by the initials of their roles; a role with another initial can only be renamed or deleted.

    A null role or text is empty, an empty role has no initial. Rows with a null conv_id are one conversation. A conversation's
    text has one hash, so its rows pass through one task, but as a stream: what is held of them are open edits.
    """
    rows = rows.select("conv_id", "turn", whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text"))
    ordered = (faults(rows.repartition(F.col("conv_id")))
               .select("conv_id", F.col("conv_id").cast("string").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("number"),
                       F.col("turn").isNotNull().alias("numbered"), "turn", "role", "text", "fault")
               .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_ordered(), F.col("fault") == DUPLICATE)
               .select("conv", "number", "numbered", "role", "text", "fault"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        out, conv, work = [], None, None
        first = last = None
        turns, kinds, illegal, initial = 0, [0] * 4, 0, None

        def closed() -> tuple:
            return (conv, last - first + 1 - turns if turns else 0, *kinds[BLANK:], illegal, *work.result())
        for pdf in batches:
            for c, number, numbered, role, text, fault in zip(pdf["conv"], pdf["number"].tolist(), pdf["numbered"].tolist(), pdf["role"],
                                                              pdf["text"], pdf["fault"].tolist()):
                c = None if c is None or c != c else c
                if work is None or c != conv:
                    if work is not None:
                        out.append(closed())
                    conv, work, first, last = c, Repair(), None, None
                    turns, kinds, illegal, initial = 0, [0] * 4, 0, None
                if numbered and (not turns or number != last):
                    first, last, turns = number if not turns else first, number, turns + 1
                kinds[fault] += 1
                illegal += initial is not None and initial + role[:1] not in LEGAL
                initial = role[:1]
                work.row(role, text, fault)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if work is not None:
            yield pd.DataFrame([closed()], columns=names)

    judged = ordered.mapInPandas(run, "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                                      "audit string, repaired_sha256 string")
    return judged.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def repaired_rows(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the conversations that the audits of judged(conv_id, audit) make of rows; turns count from 0."""
    rows = rows.select("conv_id", "turn", whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text"))
    by_conv = Window.partitionBy("conv_id")
    numbered = rows.withColumn("n", F.row_number().over(by_conv.orderBy(*_ordered()))).select(F.col("conv_id").alias("c"), "n", "role", "text")
    edits = judged.select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    so_far = by_conv.orderBy("at")
    edits = edits.withColumns({"n": F.count_if(F.col("edit") != "I").over(so_far), "turn": F.count_if(F.col("edit") != "D").over(so_far) - 1})
    found = edits.where("edit <> 'D'").join(numbered, F.col("conv_id").eqNullSafe(F.col("c")) & (edits["n"] == numbered["n"])
                                            & (F.col("edit") != "I"), "left")
    system = F.max(F.when((F.col("turn") == 0) & (F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(by_conv)
    fits = F.when((F.col("turn") - F.col("_system")) % 2 == 0, "user").otherwise("assistant")
    return (found.withColumn("_system", system)
            .select("conv_id", "turn", F.when(F.col("edit") == "K", F.col("role")).otherwise(fits).alias("role"), whole(F.col("text")).alias("text")))
