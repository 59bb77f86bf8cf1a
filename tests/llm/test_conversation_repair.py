import hashlib
import itertools
import random
import re
import zlib

from curatrix.llm import conversation_repair as cr


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    """Of (role, text) in order: the fault of each."""
    seen, out = set(), []
    for role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """By trying all edits: the cost, the least audit, and the repaired turns."""
    found = []
    made = [("", 0), ("u", 3), ("a", 3), ("ua", 6), ("au", 6)]
    choices = []
    for (role, text), fault in zip(rows, faults(rows)):
        own = [("D", 4, None)]
        if fault in ("", "truncated"):
            more = 3 if fault else 0
            own += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        choices.append(own)
    names = {"u": "user", "a": "assistant"}
    for edits in itertools.product(*choices):
        for extra in itertools.product(made, repeat=len(rows) + 1):
            audit, turns, cost = "", [], 0
            for k, (word, price) in enumerate(extra):
                audit += "I" * len(word)
                turns += [(names[w], "") for w in word]
                cost += price
                if k < len(rows):
                    letter, price, turn = edits[k]
                    audit, cost = audit + letter, cost + price
                    turns += [turn] if turn else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
                found.append((cost, audit, turns))
    cost, audit, turns = min(found, key=lambda f: f[:2])
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def plain(rows):
    """Of one conversation's rows (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    said = [(r, t) for _, r, t in rows]
    marks = faults(said)
    wrong = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), wrong, *cheapest(said))


def table(spark, rows):
    """conversations, with columns that clash with computed names."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, conv string, at int, audit string")


def reports(spark, rows, **how):
    got, _ = cr.repair(table(spark, rows), **how)
    return {r[0]: tuple(r)[1:] for r in got.collect()}


ROLES = ["user", "assistant", "system", "tool", "", "User", "agent"]
TEXTS = ["Yes.", "No", "", " \t", "Why?", "Why? ", "Well. ", "äöü!"]


def test_all_edits_tried(spark):
    rand = random.Random(7)
    rows, expect = [], {}
    for conv in range(150):
        own = sorted(((rand.choice([None, 1, 2, 3, 7]), rand.choice(ROLES[:4] if conv % 2 else ROLES), rand.choice(TEXTS)) for _ in range(rand.randint(1, 3))), key=lambda r: (r[0] is not None, r))
        rows += [(conv, *r) for r in own]
        expect[conv] = plain(own)
    assert reports(spark, rows) == expect
    assert reports(spark, rows, block_bits=0) == expect  # every row a block of its own


def test_blocks_agree_with_the_whole(spark):
    rand = random.Random(8)
    rows = [(c, k, rand.choice(ROLES[:4]), rand.choice(["Yes.", "No", "", f"Text {k}.", f"Text {k}"])) for c, n in ((1, 700), (2, 1), (3, 90), (None, 40)) for k in range(n)]
    whole = reports(spark, rows, block_bits=33)
    assert len(whole) == 4
    for bits in (1, 4, 6):
        assert reports(spark, rows, block_bits=bits) == whole


def test_dial_equals_relaxation():
    rand = random.Random(9)
    for _ in range(200):
        marks = "".join(rand.choice("uasx") + rand.choice("bdt---") for _ in range(rand.randint(0, 9)))
        n = len(marks) // 2
        best = [cr.FAR] * (4 * n + 4)
        for s in (0, 3):
            best[4 * n + s] = 0
        for _ in range(4 * n + 8):
            for i in range(n, -1, -1):
                for s in range(4):
                    ways = [best[4 * i + s], best[4 * i + cr.MADE[s]] + 3]
                    if i < n:
                        c, f = marks[2 * i], marks[2 * i + 1]
                        ways.append(best[4 * i + 4 + s] + 4)
                        if f in "t-":
                            more = 3 if f == "t" else 0
                            ways.append(best[4 * i + 4 + cr.MADE[s]] + 3 + more)
                            to = cr.kept_state(s, c)
                            if to is not None:
                                ways.append(best[4 * i + 4 + to] + more)
                    best[4 * i + s] = min(ways)
        assert cr.to_go(marks, cr.ACCEPT, True) == best


def test_turns_and_long_text(spark):
    long = "Wort " * 300_000 + "."
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", long), (1, 2, "user", "Go"), (2, 1, None, None), (3, None, "assistant", "Only.")]
    got, turns = cr.repair(table(spark, rows))
    told = {r.conv_id: (r.cost, r.audit) for r in got.collect()}
    assert told == {1: (6, "KKR"), 2: (4, "D"), 3: (3, "IK")}
    assert sorted((r.conv, r.seq, r.edit, r.role, r.text) for r in turns.collect()) == [("1", 0, "K", "system", "Be kind."), ("1", 1, "K", "user", long), ("1", 2, "R", "assistant", "Go"), ("3", 0, "I", "user", ""), ("3", 1, "K", "assistant", "Only.")]


def test_damage(spark):
    rows = [(c, t, r, x) for c in [*range(30), None] for t in (None, 0, 1, 2) for r, x in (("system", "A. B?"), (None, None))]
    got = cr.damaged(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_damage(rows), key=repr)


def test_empty_table(spark):
    got, turns = cr.repair(table(spark, []))
    assert got.collect() == [] and turns.collect() == []


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Lost."), (None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in cr.op11_conversation_repair(spark, str(tmp_path)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got[None] == plain([r[1:] for r in plain_damage(rows[1:])])
