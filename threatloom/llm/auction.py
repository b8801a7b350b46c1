"""Cheapest edits of a sequence of turns: shortest paths over a lattice of turns and grammar states, by auction.

A turn is one letter: the initial of its role (`s`, `u`, `a`, or `x` for any other), in upper case if it is truncated. Turns
that have to go are left out; their deletion changes no state. States are what a conversation of the form `(s?(ua)+)?` has
reached: nothing, a system turn, a user turn, an assistant turn. Edges: keep (K), rerole (R) or delete (D) the next turn, or
insert (I) one before it. From any state only one role can be inserted or reroled to, so that the letters tell the path.

The auction keeps a path from the origin and a price per node with price[i] <= cost(i, j) + price[j] on all arcs. The path
is extended along an arc that holds with equality; at a node without one, its price is raised to the least of its arcs and the
path is cut back by it. Costs are whole and cycles cost something, so it ends, with prices under which every arc of every
cheapest path is tight. The path of least letters is then traced over tight arcs only.

Auctions are run on blocks of up to `BLOCK` turns, once for each pair of states at the block's ends; longer sequences are
chained from these by their least costs. Of equally cheap chains that with the least letters is taken; it is enough to know
the order of a block's own edits, as two edit sequences of the same turns are never a beginning of each other.
"""

from __future__ import annotations

from functools import lru_cache

BLOCK = 32
STATES = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
#: (state, initial) -> next state
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: the role that can be inserted, or a turn be reroled to, at each state
WANTED = "uuau"
ROLE = {"u": "user", "a": "assistant"}
#: edits that end a conversation at each state
END = ("", "II", "I", "")
_NEVER = float("inf")

Arcs = list[list[tuple[str, int, int]]]


def _lattice(turns: str) -> Arcs:
    """Arcs (letter, cost, node) of each node; node = 4 * turns before it + state. The last layer has none."""
    arcs: Arcs = [[] for _ in range(4 * len(turns) + 4)]
    for at, letter in enumerate(turns):
        initial, kept = letter.lower(), TRUNCATED if letter.isupper() else 0
        for state in STATES:
            out, wanted = arcs[4 * at + state], WANTED[state]
            reached = STEP[state, wanted]
            out.append(("D", DELETE, 4 * at + 4 + state))
            out.append(("I", INSERT, 4 * at + reached))
            if (state, initial) in STEP:
                out.append(("K", KEEP + kept, 4 * at + 4 + STEP[state, initial]))
            if initial != wanted:
                out.append(("R", REROLE + kept, 4 * at + 4 + reached))
    return arcs


def _towards(arcs: Arcs, goal: int) -> Arcs:
    """The arcs from which the goal can be reached; without it prices would rise for ever."""
    back: list[list[int]] = [[] for _ in arcs]
    for i, out in enumerate(arcs):
        for _, _, j in out:
            back[j].append(i)
    reaching, todo = {goal}, [goal]
    while todo:
        for i in back[todo.pop()]:
            if i not in reaching:
                reaching.add(i)
                todo.append(i)
    return [[arc for arc in out if arc[2] in reaching] if i in reaching else [] for i, out in enumerate(arcs)]


def auction(arcs: Arcs, origin: int, goal: int, price: list[int]) -> int:
    """Least cost from origin to goal, which can be reached; prices of earlier runs for the same goal are a start."""
    path = [origin]
    while path[-1] != goal:
        i = path[-1]
        least, step = min((cost + price[j], j) for _, cost, j in arcs[i])
        if price[i] < least:
            price[i] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(step)
    return price[origin] - price[goal]


def traced(arcs: Arcs, origin: int, goal: int, price: list[int]) -> str:
    """The least letters of all paths over tight arcs; dead ends are left and not entered again."""
    path, letters, open_arcs, dead = [origin], [], [], set()
    while path[-1] != goal:
        if len(open_arcs) < len(path):
            i = path[-1]
            tight = [arc for arc in arcs[i] if price[i] == arc[1] + price[arc[2]] and arc[2] not in dead]
            open_arcs.append(sorted(tight, reverse=True))
        if open_arcs[-1]:
            letter, _, j = open_arcs[-1].pop()
            if j not in dead:
                path.append(j)
                letters.append(letter)
        else:
            dead.add(path.pop())
            open_arcs.pop()
            letters.pop()
    return "".join(letters)


#: Of a stretch of turns: least cost, edits and order among the edits from the same state, by state before and after.
Costs = tuple[tuple[float, ...], ...]
Ranks = tuple[tuple[int, ...], ...]


def _ranked(keys: list[list]) -> Ranks:
    out = []
    for row in keys:
        order = sorted({k for k in row if k is not None})
        out.append(tuple(-1 if k is None else order.index(k) for k in row))
    return tuple(out)


@lru_cache(maxsize=20_000)
def block_edits(turns: str) -> tuple[Costs, Ranks, tuple[tuple[str | None, ...], ...]]:
    """All pairs of states around at most `BLOCK` turns, by auction."""
    arcs, last = _lattice(turns), 4 * len(turns)
    cost = [[_NEVER] * 4 for _ in STATES]
    edits: list[list[str | None]] = [[None] * 4 for _ in STATES]
    for after in STATES:
        useful, price = _towards(arcs, last + after), [0] * len(arcs)
        for before in STATES:
            if useful[before] or before == last + after:
                cost[before][after] = auction(useful, before, last + after, price)
                edits[before][after] = traced(useful, before, last + after, price)
    return tuple(map(tuple, cost)), _ranked(edits), tuple(map(tuple, edits))


def joined(one: tuple[Costs, Ranks], two: tuple[Costs, Ranks]) -> tuple[Costs, Ranks]:
    """Costs and ranks of two stretches one after the other."""
    cost = [[_NEVER] * 4 for _ in STATES]
    keys: list[list] = [[None] * 4 for _ in STATES]
    for before in STATES:
        for after in STATES:
            found = [
                (one[0][before][mid] + two[0][mid][after], (one[1][before][mid], two[1][mid][after]))
                for mid in STATES
                if one[0][before][mid] < _NEVER and two[0][mid][after] < _NEVER
            ]
            if found:
                cost[before][after], keys[before][after] = min(found)
    return tuple(map(tuple, cost)), _ranked(keys)


def route(stretches: list[tuple[Costs, Ranks]], before: int, after: int | None) -> tuple[float, list[int]]:
    """Least cost and the states between stretches, first and last included; without `after`, that of the cheapest end."""
    go = [len(END[s]) * INSERT if after is None else (0 if s == after else _NEVER) for s in STATES]
    rest = [go]
    for cost, _ in reversed(stretches):
        go = [min(cost[s][t] + go[t] for t in STATES) for s in STATES]
        rest.append(go)
    rest.reverse()
    states = [before]
    for (cost, rank), ahead in zip(stretches, rest[1:]):
        s = states[-1]
        least = min(cost[s][t] + ahead[t] for t in STATES)
        states.append(min((rank[s][t], t) for t in STATES if cost[s][t] + ahead[t] == least and least < _NEVER)[1])
    return rest[0][before], states


def blocks_of(turns: str) -> list[str]:
    return [turns[at : at + BLOCK] for at in range(0, len(turns), BLOCK)]


def stretch(turns: str) -> tuple[Costs, Ranks]:
    """Costs and ranks of any number of turns."""
    whole: tuple[Costs, Ranks] | None = None
    for block in blocks_of(turns):
        one = block_edits(block)[:2]
        whole = one if whole is None else joined(whole, one)
    return whole or block_edits("")[:2]


def cheapest_edits(turns: str, before: int = 0, after: int | None = None) -> tuple[int, str]:
    """Cost and letters of the cheapest edits between two states; without `after` those that end the conversation."""
    blocks = [block_edits(block) for block in blocks_of(turns)]
    cost, states = route([b[:2] for b in blocks], before, after)
    letters = "".join(b[2][s][t] for b, s, t in zip(blocks, states, states[1:]))
    return int(cost), letters + (END[states[-1]] if after is None else "")
