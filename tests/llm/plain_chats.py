"""Conversation repair by search over whole audits, in plain Python: what the operator has to give for small conversations."""

import hashlib
import re
from functools import lru_cache
from zlib import crc32

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    """(conv, turn, role, text) rows after the damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def fix(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of the damaged rows of one conversation."""
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    rows = sorted(rows, key=lambda row: (row[1] is not None, row[1] or 0, digest(row[2], row[3])))
    seen, marks = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        marks.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(at, state, inserted):
        """Least (cost, audit) from row ``at`` in a state; at most two rows are ever worth inserting at one place."""
        found = [(0, "")] if at == len(rows) and state in ("", "a") else []
        if inserted < 2:
            cost, audit = best(at, NEXT[state], inserted + 1)
            found.append((cost + 3, "I" + audit))
        if at < len(rows):
            cost, audit = best(at + 1, state, 0)
            found.append((cost + 4, "D" + audit))
            if marks[at] not in ("blank", "duplicate"):
                extra, initial = 3 * (marks[at] == "truncated"), rows[at][2][:1]
                cost, audit = best(at + 1, NEXT[state], 0)
                found.append((cost + 3 + extra, "R" + audit))
                if initial == NEXT[state] or (initial == "s" and state == ""):
                    cost, audit = best(at + 1, initial, 0)
                    found.append((cost + extra, "K" + audit))
        return min(found) if found else (10 ** 9, "")

    for at in range(len(rows), -1, -1):  # from the end, so that no search goes deep
        for state in NEXT:
            best(at, state, 0)
    cost, audit = best(0, "", 0)
    state, at, lines = "", 0, []
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            lines.append(NAMES[state] + ":")
            continue
        if letter == "K":
            state = rows[at][2][:1]
            lines.append(f"{rows[at][2]}:{rows[at][3]}")
        elif letter == "R":
            state = NEXT[state]
            lines.append(f"{NAMES[state]}:{rows[at][3]}")
        at += 1
    turns = [row[1] for row in rows if row[1] is not None]
    initials = [row[2][:1] for row in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(name) for name in ("blank", "duplicate", "truncated")),
            sum(one + two not in ("su", "ua", "au") for one, two in zip(initials[:-1], initials[1:], strict=True)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    """{conversation: result} of undamaged rows."""
    hurt = damage(rows)
    return {conv: fix([row for row in hurt if row[0] == conv]) for conv in {row[0] for row in rows}}
