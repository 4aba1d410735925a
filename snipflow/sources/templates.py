"""Our template library for corpus generation (J1): bodies, labels, naming pools.

Bodies use ``__TOKEN__`` placeholders. ``__FUNC__`` takes the function name;
role tokens take a name from one of five naming styles; any other token is
lower-cased. Problems, bodies and names are this project's; only the 17 class
labels are shared values.
"""

from __future__ import annotations

# --- fixed values: class labels ------------------------------------------------
FLAT_LABELS = {
    "bfs": "BFS",
    "dfs": "DFS",
    "dp": "Dynamic Programming",
    "backtracking": "Backtracking",
    "two_pointer": "Two Pointer",
    "sliding_window": "Sliding Window",
    "binary_search": "Binary Search",
    "union_find": "Union-Find",
    "monotonic_stack": "Monotonic Stack",
    "linked_list": "Linked List Operations",
}
SORT_LABELS = [
    "In-Place Nested-Loop Swap Sort",
    "Shift-Based Sort",
    "Recursive Non-Swap Sort",
    "Recursive Swap-Based Sort",
    "Heap/Complex Structural Sort",
    "Distribution Sort",
    "Single-Pass Loop Sort",
]
VARIANTS_PER_TEMPLATE = 5
# ------------------------------------------------------------------------------

# Role token -> five spellings (style 0..4). Ours.
ROLE_NAMES = {
    "ARR": ["series", "records", "entries", "batch", "readings"],
    "LEN": ["width", "how_many", "span_len", "extent", "amount"],
    "AT": ["pos", "slot", "step", "cell", "spot"],
    "OUT": ["found", "report", "picked", "outcome", "gathered"],
    "HELD": ["carried", "held", "lifted", "moving", "aside"],
    "AIM": ["aim", "quota", "limit", "sought", "mark"],
    "MET": ["visited", "seen", "known", "familiar", "noted"],
    "LINE": ["waiting", "line", "upcoming", "turns", "backlog"],
    "PILE": ["tower", "heap_of", "column", "kept", "pile"],
    "MAP": ["roads", "adj", "links", "graph", "bridges"],
    "SPOT": ["town", "place", "room", "station", "site"],
    "NEAR": ["nearby", "door", "neighbour", "exit_to", "reach"],
    "LOW": ["left", "lo", "low", "near_end", "front"],
    "TOP": ["right", "hi", "high", "far_end", "rear"],
    "HALF": ["half", "probe", "centre", "guess", "trial"],
    "TALLY": ["tally", "ledger", "votes", "stock", "census"],
    "KNOWN": ["memo", "cache", "solved", "answers", "book"],
    "HEAD_OF": ["parent", "captain", "chief", "owner", "head_of"],
    "HERE": ["link", "wagon", "bead", "here", "car"],
    "SUM": ["load", "weight", "volume", "spent", "level"],
}

FUNC_NAMES = {
    "bfs": ["rumour_days", "spread_out", "fewest_turns", "ripple"],
    "dfs": ["dig", "wander", "follow_down", "unfold"],
    "dp": ["cheapest_plan", "tabulate", "best_score", "plan_ahead"],
    "backtracking": ["try_all", "attempt", "list_choices", "puzzle"],
    "two_pointer": ["close_in", "both_ends", "sweep_pair", "match_up"],
    "sliding_window": ["busiest_span", "moving_span", "frame", "recent"],
    "binary_search": ["narrow_down", "halving", "threshold", "pin_down"],
    "union_find": ["team_up", "join_all", "alliances", "cluster"],
    "monotonic_stack": ["skyline", "keep_rising", "trim_tower", "outlook"],
    "linked_list": ["rewire", "shunt", "splice", "thread_beads"],
    "sorting": ["tidy", "line_up", "in_order", "rank_all"],
}

# (func_key, label, original_name, body)
_T: list[tuple[str, str, str, str]] = []


def _add(key: str, label: str, name: str, body: str) -> None:
    _T.append((key, label, name, body))


# ------------------------------------------------------------------- BFS ------
_add("bfs", "BFS", "rumour per day", '''
from collections import deque

def __FUNC__(friends, first):
    # how many people hear the rumour on each day
    __MET__ = {first}
    __LINE__ = deque([[first]])
    heard = []
    while __LINE__:
        today = __LINE__.popleft()
        heard.append(len(today))
        fresh = []
        for teller in today:
            for friend in friends.get(teller, ()):
                if friend not in __MET__:
                    __MET__.add(friend)
                    fresh.append(friend)
        if fresh:
            __LINE__.append(fresh)
    return heard
''')
_add("bfs", "BFS", "dial lock", '''

from collections import deque

def __FUNC__(opening, secret, jammed):
	# tab-indented comment line
    turns = {opening: 0}
    __LINE__ = deque([opening])
    while __LINE__ and secret not in turns:
        dial = __LINE__.popleft()
        for wheel in range(len(dial)):
            for turn in (1, 9):
                digit = (int(dial[wheel]) + turn) % 10
                other = dial[:wheel] + str(digit) + dial[wheel + 1:]
                if other not in jammed and other not in turns:
                    turns[other] = turns[dial] + 1
                    __LINE__.append(other)
    return turns.get(secret)  # None if jammed shut

''')
_add("bfs", "BFS", "jug pouring", '''
from collections import deque

def __FUNC__(big, small, __AIM__):
    # fewest pours that leave the wanted volume in one of two jugs
    __MET__ = set([(0, 0)])
    __LINE__ = deque([(0, 0, 0)])
    while __LINE__:
        a, b, pours = __LINE__.popleft()
        if __AIM__ in (a, b):
            return pours
        moved, back = min(a, small - b), min(b, big - a)
        states = [(big, b), (a, small), (0, b), (a, 0), (a - moved, b + moved), (a + back, b - back)]
        for state in states:
            if state not in __MET__:
                __MET__.add(state)
                __LINE__.append(state + (pours + 1,))
    return -1
''')
# ------------------------------------------------------------------- DFS ------
_add("dfs", "DFS", "folder sizes", '''
def __FUNC__(folder, prefix=""):
    # bytes below every folder, deepest first
    __OUT__ = {}
    total = 0
    for label, content in folder.items():
        if isinstance(content, dict):
            inner = __FUNC__(content, prefix + "/" + label)
            __OUT__.update(inner)
            total += inner[prefix + "/" + label]
        else:
            total += content
    __OUT__[prefix] = total
    return __OUT__
''')
_add("dfs", "DFS", "flatten parcels", '''
def __FUNC__(parcel):
    __PILE__ = [iter(parcel)]
    __OUT__ = []
    while __PILE__:
        try:
            inside = next(__PILE__[-1])
        except StopIteration:
            __PILE__.pop()
            continue
        if isinstance(inside, (list, tuple)):
            __PILE__.append(iter(inside))
        else:
            __OUT__.append(inside)
    return __OUT__
''')
_add("dfs", "DFS", "import cycle", '''
def __FUNC__(__MAP__):
    # a module that imports itself through others, if any
    __MET__ = dict()

    def __HELPER__(__SPOT__):
        if __MET__.get(__SPOT__) == "open":
            return __SPOT__
        if __SPOT__ in __MET__:
            return None
        __MET__[__SPOT__] = "open"
        for __NEAR__ in __MAP__.get(__SPOT__, []):
            culprit = __HELPER__(__NEAR__)
            if culprit is not None:
                return culprit
        __MET__[__SPOT__] = "closed"
        return None

    for __SPOT__ in sorted(__MAP__):
        culprit = __HELPER__(__SPOT__)
        if culprit is not None:
            return culprit
''')
# ------------------------------------------------------------- DP -------------
_add("dp", "Dynamic Programming", "museum passes", '''
def __FUNC__(visits, day_price, week_price):
    last = max(visits, default=0)
    cost = [[0, 0] for _ in range(last + 8)]
    for day in range(8, last + 8):
        single = cost[day - 1][0] + day_price
        weekly = cost[day - 7][0] + week_price
        for kind in (0, 1):
            cost[day][kind] = cost[day - 1][0]
            if day - 7 in visits:
                cost[day][kind] = min(single, weekly)
    return cost[last + 7][0]
''')
_add("dp", "Dynamic Programming", "stone game", '''
def __FUNC__(__ARR__, first, last, __KNOWN__={}):
    # lead of the player who takes stones from either end
    if first > last:
        return 0
    key = (first, last)
    if key not in __KNOWN__:
        take_first = __ARR__[first] - __FUNC__(__ARR__, first + 1, last, __KNOWN__)
        take_last = __ARR__[last] - __FUNC__(__ARR__, first, last - 1, __KNOWN__)
        __KNOWN__[key] = max(take_first, take_last)
    return __KNOWN__[key]
''')
_add("dp", "Dynamic Programming", "mirror spans", '''
def __FUNC__(text):
    __LEN__ = len(text)
    mirror = [[False] * __LEN__ for _ in range(__LEN__)]
    total = 0
    for start in range(__LEN__ - 1, -1, -1):
        for stop in range(start, __LEN__):
            inner = stop - start < 2 or mirror[start + 1][stop - 1]
            mirror[start][stop] = inner and text[start] == text[stop]
            if mirror[start][stop]:
                total += 1
    return total
''')
# ----------------------------------------------------------- backtracking -----
_add("backtracking", "Backtracking", "balanced brackets", '''
def __FUNC__(pairs):
    __OUT__ = []
    written = []

    def __HELPER__(opened, closed):
        if closed == pairs:
            __OUT__.append("".join(written))
        for sign in "()":
            opens = sign == "("
            if (opens and opened < pairs) or (not opens and closed < opened):
                written.append(sign)
                __HELPER__(opened + opens, closed + (not opens))
                written.pop()

    __HELPER__(0, 0)
    return __OUT__
''')
_add("backtracking", "Backtracking", "split into words", '''
def __FUNC__(letters, dictionary):
    sentences = []
    words = []

    def __HELPER__(rest):
        if not rest:
            sentences.append(" ".join(words))
        for word in dictionary:
            if rest.startswith(word):
                words.append(word)
                __HELPER__(rest[len(word):])
                words.pop()

    __HELPER__(letters)
    return sentences
''')
_add("backtracking", "Backtracking", "round trips", '''
def __FUNC__(__MAP__, home):
    # every tour that returns home without passing a place twice
    __OUT__ = []
    trail = [home]

    def __HELPER__(__SPOT__):
        if home in __MAP__[__SPOT__] and len(trail) > 2:
            __OUT__.append(tuple(trail))
        for __NEAR__ in __MAP__[__SPOT__]:
            if __NEAR__ not in trail:
                trail.append(__NEAR__)
                __HELPER__(__NEAR__)
                trail.pop()

    __HELPER__(home)
    return __OUT__
''')
# ----------------------------------------------------------- two pointer ------
_add("two_pointer", "Two Pointer", "mirror phrase", '''
def __FUNC__(phrase):
    __LOW__ = 0
    __TOP__ = len(phrase) - 1
    while __LOW__ < __TOP__:
        if not phrase[__LOW__].isalpha():
            __LOW__ += 1
        elif not phrase[__TOP__].isalpha():
            __TOP__ -= 1
        elif phrase[__LOW__].lower() != phrase[__TOP__].lower():
            return False
        else:
            __LOW__ += 1
            __TOP__ -= 1
    return True
''')
_add("two_pointer", "Two Pointer", "squeeze blanks", '''
def __FUNC__(__ARR__):
    # runs of blanks become one blank, in place
    __LEN__ = 0
    for letter in __ARR__:
        if letter != " " or (__LEN__ and __ARR__[__LEN__ - 1] != " "):
            __ARR__[__LEN__] = letter
            __LEN__ += 1
    del __ARR__[__LEN__:]
    return __ARR__
''')
_add("two_pointer", "Two Pointer", "shared free time", '''
def __FUNC__(mine, yours, minutes):
    m = y = 0
    while m < len(mine) and y < len(yours):
        begin = max(mine[m][0], yours[y][0])
        finish = min(mine[m][1], yours[y][1])
        if finish - begin >= minutes:
            return begin, begin + minutes
        if mine[m][1] == finish:
            m += 1
        else:
            y += 1
    return None
''')
# --------------------------------------------------------- sliding window -----
_add("sliding_window", "Sliding Window", "login burst", '''
def __FUNC__(stamps, seconds):
    oldest = 0
    peak = 0
    for newest, stamp in enumerate(stamps):
        while stamp - stamps[oldest] > seconds:
            oldest += 1
        peak = max(peak, newest - oldest + 1)
    return peak
''')
_add("sliding_window", "Sliding Window", "repaired streak", '''
def __FUNC__(days, repairs):
    # longest streak of good days if some bad ones may be repaired
    bad = start = longest = 0
    for today in range(len(days)):
        bad += not days[today]
        while bad - repairs > 0:
            bad -= not days[start]
            start += 1
        longest = max(longest, today + 1 - start)
    return longest
''')
_add("sliding_window", "Sliding Window", "steady readings", '''
def __FUNC__(__ARR__, tolerance):
    begin = 0
    spans = []
    for finish in range(len(__ARR__)):
        frame = __ARR__[begin:finish + 1]
        while max(frame) - min(frame) > tolerance:
            begin += 1
            frame = __ARR__[begin:finish + 1]
        spans.append((begin, finish))
    return max(spans, key=lambda s: s[1] - s[0])
''')
# --------------------------------------------------------- binary search ------
_add("binary_search", "Binary Search", "mountain peak", '''
def __FUNC__(heights):
    __LOW__ = 0
    __TOP__ = len(heights) - 1
    while __LOW__ < __TOP__:
        __HALF__ = (__LOW__ + __TOP__) // 2
        uphill = heights[__HALF__ + 1] > heights[__HALF__]
        __LOW__ = __HALF__ + 1 if uphill else __LOW__
        __TOP__ = __TOP__ if uphill else __HALF__
    return heights[__LOW__]
''')
_add("binary_search", "Binary Search", "citation index", '''
def __FUNC__(citations):
    # largest h with h papers of at least h citations; citations descend
    __LOW__ = 0
    __TOP__ = len(citations)
    while __TOP__ - __LOW__ > 0:
        __HALF__ = (__LOW__ + __TOP__ + 1) // 2
        if citations[__HALF__ - 1] < __HALF__:
            __TOP__ = __HALF__ - 1
        else:
            __LOW__ = __HALF__
    return __LOW__
''')
_add("binary_search", "Binary Search", "cube side", '''
def __FUNC__(volume):
    __LOW__ = 0.0
    __TOP__ = volume + 1.0
    for _ in range(80):
        __HALF__ = (__LOW__ + __TOP__) / 2
        if __HALF__ ** 3 > volume:
            __TOP__ = __HALF__
        else:
            __LOW__ = __HALF__
    return round(__LOW__, 6)
''')
# ------------------------------------------------------------ union-find ------
_add("union_find", "Union-Find", "shared mailboxes", '''
def __FUNC__(accounts):
    __HEAD_OF__ = {}

    def find_owner(mail):
        while mail in __HEAD_OF__:
            mail = __HEAD_OF__[mail]
        return mail

    def union_mails(mails):
        owners = sorted(set(map(find_owner, mails)))
        __HEAD_OF__.update(dict.fromkeys(owners[1:], owners[0]))

    for mails in accounts.values():
        union_mails(mails)
    return {person: find_owner(mails[0]) for person, mails in accounts.items()}
''')
_add("union_find", "Union-Find", "rival camps", '''
class Camps:
    def __init__(self):
        self.link = {}

    def find_camp(self, who):
        if who not in self.link:
            return who, 0
        chief, side = self.find_camp(self.link[who][0])
        return chief, side ^ self.link[who][1]

    def union_rivals(self, one, two):
        # False if both already stand on one side
        first, side_one = self.find_camp(one)
        second, side_two = self.find_camp(two)
        if first == second:
            return side_one != side_two
        self.link[first] = (second, 1 ^ side_one ^ side_two)
        return True
''')
_add("union_find", "Union-Find", "cheapest cabling", '''
def __FUNC__(cables):
    # total price of the cables that join all houses
    __HEAD_OF__ = dict()
    price = 0

    def find_hub(house):
        hub = __HEAD_OF__.get(house, house)
        return house if hub == house else find_hub(hub)

    def union_houses(one, two):
        __HEAD_OF__[find_hub(one)] = find_hub(two)

    for cost, one, two in sorted(cables):
        if find_hub(one) != find_hub(two):
            union_houses(one, two)
            price += cost
    return price
''')
# ------------------------------------------------------- monotonic stack ------
_add("monotonic_stack", "Monotonic Stack", "sea view", '''
def __FUNC__(buildings):
    __PILE__ = []
    for floors, address in reversed(buildings):
        while __PILE__ and __PILE__[0][0] > floors and len(__PILE__) > 9:
            __PILE__.pop()
        if not __PILE__ or floors > __PILE__[-1][0]:
            __PILE__.append((floors, address))
    return [address for _, address in __PILE__]
''')
_add("monotonic_stack", "Monotonic Stack", "smallest number", '''
def __FUNC__(digits, drop):
    # smallest number left after dropping some digits
    __PILE__ = []
    for digit in digits:
        while drop and __PILE__ and __PILE__[-1] > digit:
            __PILE__.pop()
            drop -= 1
        __PILE__.append(digit)
    kept = __PILE__[:len(__PILE__) - drop]
    return "".join(kept).lstrip("0") or "0"
''')
_add("monotonic_stack", "Monotonic Stack", "falling asteroids", '''
def __FUNC__(rocks):
    __PILE__ = []
    for rock in rocks:
        alive = True
        while alive and __PILE__ and rock < 0 < __PILE__[-1]:
            alive = __PILE__[-1] + rock < 0
            if __PILE__[-1] + rock <= 0:
                __PILE__.pop()
        if alive:
            __PILE__.append(rock)
    return __PILE__
''')
# ----------------------------------------------------------- linked list ------
_add("linked_list", "Linked List Operations", "detour stop", '''
class Stop:
    def __init__(self, title):
        self.title = title
        self.next = None

def __FUNC__(route, wanted, title):
    __HERE__ = route
    while __HERE__ and __HERE__.title != wanted:
        __HERE__ = __HERE__.next
    if __HERE__:
        extra = Stop(title)
        extra.next = __HERE__.next
        __HERE__.next = extra
    return route
''')
_add("linked_list", "Linked List Operations", "drop every second", '''
class Wagon:
    def __init__(self, cargo):
        self.cargo = cargo
        self.next = None

def __FUNC__(engine):
    # uncouple every second wagon
    __HERE__ = engine
    while __HERE__ and __HERE__.next:
        __HERE__.next = __HERE__.next.next
        __HERE__ = __HERE__.next
    return engine
''')
_add("linked_list", "Linked List Operations", "zip two chains", '''
class Bead:
    def __init__(self, colour):
        self.colour = colour
        self.next = None

def __FUNC__(one, two):
    start = one
    while one and two:
        after_one = one.next
        after_two = two.next
        one.next = two
        two.next = after_one or after_two
        one = after_one
        two = after_two
    return start
''')
# ------------------------------------------------------------- sorting --------
_S = "sorting"
_add(_S, "In-Place Nested-Loop Swap Sort", "Rank Partition Sort", '''
def __FUNC__(__ARR__, ranks):
    edge = 0
    for rank in ranks:
        for __AT__ in range(edge, len(__ARR__)):
            if __ARR__[__AT__][0] == rank:
                __ARR__[__AT__], __ARR__[edge] = __ARR__[edge], __ARR__[__AT__]
                edge += 1
    return __ARR__
''')
_add(_S, "In-Place Nested-Loop Swap Sort", "Cocktail Sort", '''
def __FUNC__(__ARR__):
    # sweep up and down between two closing walls
    walls = [0, len(__ARR__) - 1]
    while walls[0] < walls[1]:
        for __AT__ in range(walls[0], walls[1]):
            if __ARR__[__AT__ + 1] < __ARR__[__AT__]:
                __ARR__[__AT__ + 1], __ARR__[__AT__] = __ARR__[__AT__], __ARR__[__AT__ + 1]
        walls[1] -= 1
        for __AT__ in range(walls[1], walls[0], -1):
            if __ARR__[__AT__] < __ARR__[__AT__ - 1]:
                __ARR__[__AT__], __ARR__[__AT__ - 1] = __ARR__[__AT__ - 1], __ARR__[__AT__]
        walls[0] += 1
    return __ARR__
''')
_add(_S, "In-Place Nested-Loop Swap Sort", "Odd-Even Sort", '''
def __FUNC__(__ARR__):
    for turn in range(len(__ARR__)):
        for __AT__ in range(turn & 1, len(__ARR__) - 1, 2):
            pair = __ARR__[__AT__:__AT__ + 2]
            if pair[0] > pair[1]:
                __ARR__[__AT__], __ARR__[__AT__ + 1] = pair[1], pair[0]
    return __ARR__
''')
_add(_S, "Shift-Based Sort", "Hand Rank Sort", '''
def __FUNC__(__ARR__):
    for __AT__, card in enumerate(list(__ARR__)):
        rank = 0
        while rank < __AT__ and __ARR__[rank] <= card:
            rank += 1
        __ARR__.insert(rank, __ARR__.pop(__AT__))
    return __ARR__
''')
_add(_S, "Shift-Based Sort", "Two-End Sort", '''
from collections import deque

def __FUNC__(__ARR__):
    shelf = deque()
    for __HELD__ in __ARR__:
        turned = 0
        while turned < len(shelf) and shelf[0] < __HELD__:
            shelf.rotate(-1)
            turned += 1
        shelf.appendleft(__HELD__)
        shelf.rotate(turned)
    return list(shelf)
''')
_add(_S, "Shift-Based Sort", "Slice Shift Sort", '''
def __FUNC__(__ARR__):
    # the block of larger values moves up by one
    for __AT__ in range(1, len(__ARR__)):
        __HELD__ = __ARR__[__AT__]
        gap = sum(1 for before in __ARR__[:__AT__] if before <= __HELD__)
        __ARR__[gap + 1:__AT__ + 1] = __ARR__[gap:__AT__]
        __ARR__[gap] = __HELD__
    return __ARR__
''')
_add(_S, "Recursive Non-Swap Sort", "Strand Sort", '''
from heapq import merge

def __FUNC__(__ARR__):
    if not __ARR__:
        return []
    strand, rest = [__ARR__[0]], []
    for __HELD__ in __ARR__[1:]:
        if __HELD__ < strand[-1]:
            rest.append(__HELD__)
        else:
            strand.append(__HELD__)
    return list(merge(strand, __FUNC__(rest)))
''')
_add(_S, "Recursive Non-Swap Sort", "Prefix Trie Sort", '''
def __FUNC__(words, depth=0):
    ended = [word for word in words if len(word) == depth]
    shelves = {}
    for word in words:
        if len(word) > depth:
            shelves.setdefault(word[depth], []).append(word)
    for letter in map(chr, range(128)):
        if letter in shelves:
            ended = ended + __FUNC__(shelves[letter], depth + 1)
    return ended
''')
_add(_S, "Recursive Non-Swap Sort", "Head Placing Sort", '''
def __FUNC__(__ARR__):
    # order the tail, then place the head
    if len(__ARR__) < 2:
        return __ARR__
    head, tail = __ARR__[0], __FUNC__(__ARR__[1:])
    smaller = [x for x in tail if x < head]
    return smaller + [head] + tail[len(smaller):]
''')
_add(_S, "Recursive Swap-Based Sort", "Slow Sort", '''
def __FUNC__(__ARR__, first, last):
    if first >= last:
        return
    centre = first + (last - first) // 2
    __FUNC__(__ARR__, first, centre)
    __FUNC__(__ARR__, centre + 1, last)
    for __AT__ in (centre,):
        if __ARR__[__AT__] > __ARR__[last]:
            __ARR__[__AT__], __ARR__[last] = __ARR__[last], __ARR__[__AT__]
    __FUNC__(__ARR__, first, last - 1)
''')
_add(_S, "Recursive Swap-Based Sort", "Stooge Sort", '''
def __FUNC__(__ARR__, first, size):
    for last in [first + size - 1]:
        if __ARR__[first] > __ARR__[last]:
            __ARR__[first], __ARR__[last] = __ARR__[last], __ARR__[first]
    if size > 2:
        part = size - size // 3
        __FUNC__(__ARR__, first, part)
        __FUNC__(__ARR__, first + size - part, part)
        __FUNC__(__ARR__, first, part)
''')
_add(_S, "Recursive Swap-Based Sort", "Circle Sort", '''
def __FUNC__(__ARR__, first, last):
    # mirrored positions are put in order, then both halves
    if first >= last:
        return 0
    swaps = 0
    for offset in range((last - first + 1) // 2):
        if __ARR__[first + offset] > __ARR__[last - offset]:
            __ARR__[first + offset], __ARR__[last - offset] = __ARR__[last - offset], __ARR__[first + offset]
            swaps += 1
    cut = first + (last - first) // 2
    return swaps + __FUNC__(__ARR__, first, cut) + __FUNC__(__ARR__, cut + 1, last)
''')
_add(_S, "Heap/Complex Structural Sort", "Replacement Run Sort", '''
import heapq

def __FUNC__(__ARR__, room=8):
    waiting = [(0, x) for x in __ARR__[:room]]
    heapq.heapify(waiting)
    runs = {}
    for x in __ARR__[room:]:
        run, least = heapq.heappop(waiting)
        runs.setdefault(run, []).append(least)
        heapq.heappush(waiting, (run + (x < least), x))
    while waiting:
        run, least = heapq.heappop(waiting)
        runs.setdefault(run, []).append(least)
    return list(heapq.merge(*runs.values()))
''')
_add(_S, "Heap/Complex Structural Sort", "Nearly Ordered Heap Sort", '''
import heapq

def __FUNC__(__ARR__, drift):
    # every value lies within drift places of its own
    near = __ARR__[:drift]
    heapq.heapify(near)
    __OUT__ = [heapq.heappushpop(near, late) for late in __ARR__[drift:]]
    while near:
        __OUT__.append(heapq.heappop(near))
    return __OUT__
''')
_add(_S, "Heap/Complex Structural Sort", "Shelf Merge Sort", '''
import heapq

def __FUNC__(shelves):
    fronts = []
    for number, shelf in enumerate(shelves):
        if shelf:
            heapq.heappush(fronts, (shelf[0], number, 0))
    __OUT__ = []
    while fronts:
        least, number, __AT__ = heapq.heappop(fronts)
        __OUT__.append(least)
        if __AT__ + 1 < len(shelves[number]):
            heapq.heappush(fronts, (shelves[number][__AT__ + 1], number, __AT__ + 1))
    return __OUT__
''')
_add(_S, "Distribution Sort", "Calendar Sort", '''
def __FUNC__(events):
    months = {}
    for title, month in events:
        months[month] = months.get(month, []) + [title]
    __OUT__ = []
    for month in range(1, 13):
        __OUT__ += months.get(month, [])
    return __OUT__
''')
_add(_S, "Distribution Sort", "Word Length Sort", '''
def __FUNC__(words):
    # one drawer per length, emptied in order
    drawers = [[]]
    for word in words:
        while len(drawers) <= len(word):
            drawers.append([])
        drawers[len(word)].append(word)
    return [word for drawer in drawers for word in drawer]
''')
_add(_S, "Distribution Sort", "Ballot Sort", '''
def __FUNC__(ballots):
    __TALLY__ = {}
    for name in ballots:
        __TALLY__[name] = __TALLY__.get(name, 0) + 1
    places = [[] for _ in range(len(ballots) + 1)]
    for name in __TALLY__:
        places[__TALLY__[name]].append(name)
    return [name for place in places[::-1] for name in place]
''')
_add(_S, "Single-Pass Loop Sort", "Drop Sort", '''
def __FUNC__(__ARR__):
    risen = []
    for __HELD__ in __ARR__:
        if not risen or __HELD__ >= risen[-1]:
            risen.append(__HELD__)
    return risen
''')
_add(_S, "Single-Pass Loop Sort", "Shelf Insert Sort", '''
from bisect import insort

def __FUNC__(__ARR__):
    # each value goes straight to its place
    shelf = []
    for __HELD__ in __ARR__:
        insort(shelf, __HELD__)
    return shelf
''')
_add(_S, "Single-Pass Loop Sort", "Least Removal Sort", '''
def __FUNC__(__ARR__):
    pool, ordered = list(__ARR__), []
    while pool:
        ordered.append(pool.pop(pool.index(min(pool))))
    return ordered
''')

TEMPLATES = list(_T)
STYLES = 5
