"""Cheapest edits of a conversation's roles by the auction algorithm for shortest paths.

The lattice. Node (i, s): i rows are read, the roles put out so far end in state s. Arcs keep, rerole or
delete row i, or insert a turn; costs are whole numbers. The roles put out have to read `(s?(ua)+)?`.

The auction. Every node has a price, a lower bound of its distance to the end, so no arc is worth less
than its two prices differ. A path grows from the origin: if the price of its last node is below the
cheapest offer (arc cost plus price of the next node), the price rises to that offer and the path contracts by
the node; otherwise the path extends along the cheapest arc. When it reaches the end, the origin's price is
its distance, and an arc lies on a cheapest path only if it is tight: cost equals price difference.

A long conversation is auctioned from its last SEGMENT rows to its first: the nodes where a segment ends have
exact prices and are destinations, the nodes where it begins are origins one after the other, with the prices
kept between them. So prices climb by what a segment costs, not by what the conversation costs, and the
work grows with the number of rows.

The trace. From the start, the least letter (D, I, K, R) of a tight arc from which the end can be reached by
tight arcs. A node has one arc for each letter, so this is the least of all cheapest audits.
"""

from __future__ import annotations

from array import array

#: States of the roles put out: nothing yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the only role that may be inserted or set; keeping a system row is the other way on.
NEXT = (USER, USER, ASSISTANT, USER)
#: A row as one byte: class of its role's initial (s, u, a, other), 4 if it must go, 8 if it is cut off.
OTHER, MUST_GO, CUT_OFF = 3, 4, 8
#: Costs of the edits.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
SEGMENT = 32


def arcs(rows: bytes, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, row, state) of the arcs out of a node, in the order of their letters."""
    found = []
    if i < len(rows):
        found.append(("D", DELETE, i + 1, state))
    found.append(("I", INSERT, i, NEXT[state]))
    if i < len(rows) and not rows[i] & MUST_GO:
        extra = CUT if rows[i] & CUT_OFF else 0
        role = (rows[i] & 3) + 1  # the state it leads to
        if role == NEXT[state] or (role == SYSTEM and state == START):
            found.append(("K", extra, i + 1, role))
        if role != NEXT[state]:
            found.append(("R", REROLE + extra, i + 1, NEXT[state]))
    return found


def may_end(state: int) -> bool:
    return state in (START, ASSISTANT)


class Lattice:
    """The lattice of one conversation with the prices that the auction has reached."""

    def __init__(self, rows: bytes) -> None:
        self.rows = rows
        self.bounds = [*range(0, len(rows), SEGMENT), len(rows)] if rows else [0, 0]
        self.price = array("q", bytes(32 * (len(rows) + 1)))
        for k in range(len(self.bounds) - 2, -1, -1):
            self._auction(self.bounds[k], self.bounds[k + 1], k == len(self.bounds) - 2)

    @property
    def cost(self) -> int:
        return self.price[START]

    def _offers(self, i: int, state: int, end: int, last: bool) -> list[tuple[str, int, int | None]]:
        """(letter, arc cost plus price, node) of a node in a segment; no letter and node at the end of all."""
        found = [(a, c + self.price[4 * r + s], 4 * r + s) for a, c, r, s in arcs(self.rows, i, state)]
        if last and i == end and may_end(state):
            found.append(("", 0, None))
        return found

    def _auction(self, first: int, end: int, last: bool) -> None:
        price = self.price
        if not last:
            # the same for all nodes, so no arc is worth less than its prices differ
            least = min(price[4 * end : 4 * end + 4])
            for node in range(4 * first, 4 * end):
                price[node] = least
        # the nodes a later segment begins with are exact; those at the end of all have arcs to the end
        final = 4 * end if not last else 4 * (end + 1)
        origins = (START,) if first == 0 else range(4)
        for origin in origins:
            path = [4 * first + origin]
            while True:
                here = path[-1]
                _, offer, target = min(self._offers(here >> 2, here & 3, end, last), key=lambda o: o[1])
                if price[here] < offer:
                    price[here] = offer
                    if len(path) > 1:
                        path.pop()
                elif target is None or target >= final:
                    break
                else:
                    path.append(target)

    def audit(self) -> str:
        """The letters of the cheapest edits, least in ASCII."""
        letters, state = [], START
        for k in range(len(self.bounds) - 1):
            state = self._trace(self.bounds[k], self.bounds[k + 1], k == len(self.bounds) - 2, state, letters)
        return "".join(letters)

    def _trace(self, first: int, end: int, last: bool, state: int, letters: list[str]) -> int:
        price = self.price
        # nodes from which tight arcs lead to the end of the segment
        good = set() if last else {4 * end + s for s in range(4)}
        for i in range(end if last else end - 1, first - 1, -1):
            for _ in range(3):  # an insert may lead to a node of the same row, at most three in turn
                for s in range(4):
                    node = 4 * i + s
                    if node not in good and any(
                        o == price[node] and (n is None or n in good) for _, o, n in self._offers(i, s, end, last)
                    ):
                        good.add(node)
        node = 4 * first + state
        while last or node < 4 * end:
            tight = [
                (a, n)
                for a, o, n in self._offers(node >> 2, node & 3, end, last)
                if o == price[node] and (n is None or n in good)
            ]
            letter, target = min(tight)
            if target is None:
                break
            letters.append(letter)
            node = target
        return node & 3
