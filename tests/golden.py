"""Golden snippets of this project's own small problems, with feature values
derived by reading the feature definitions (SURVEY 2.D). Keys of ``expect`` are feature
numbers (1-based); every feature not listed must be 0."""

GOLDEN = {
    "cube_side": ("""
def cube_side(volume):
    left, right = 0.0, volume + 1.0
    for _ in range(60):
        side = (left + right) / 2
        if side ** 3 > volume:
            right = side
        else:
            left = side
    return left
""", {1: 1, 2: 1, 17: 1, 18: 1, 20: 1, 39: 1}, 1),
    "mirror_word": ("""
def mirror(word):
    left = 0
    right = len(word) - 1
    while left < right:
        if word[left] != word[right]:
            return False
        left += 1
        right -= 1
    return True
""", {1: 1, 2: 1, 13: 1, 16: 1, 17: 1, 18: 1, 19: 1, 20: 1}, 15),
    "settle_seats": ("""
def settle(seats, wish):
    for _ in seats:
        for spot, guest in enumerate(wish):
            if spot != guest:
                seats[spot], seats[guest] = seats[guest], seats[spot]
    return seats
""", {1: 2, 2: 2, 13: 1, 14: 1, 17: 1, 18: 1, 20: 2}, 18),
    "rumour": ("""
from collections import deque

def rumour(first, friends_of):
    visited = {first}
    line = deque([first])
    while line:
        teller = line.popleft()
        fresh = [f for f in friends_of[teller] if f not in visited]
        visited.update(fresh)
        line.extend(fresh)
    return visited
""", {1: 1, 2: 1, 7: 1, 9: 1, 11: 1, 13: 1, 17: 1, 20: 2}, 14),
    "pour_cups": ("""
def drain(jug, cups, memo={}):
    if jug < 0:
        return 0
    if jug == 0:
        return 1
    if jug not in memo:
        memo[jug] = sum(drain(jug - cup, cups, memo) for cup in cups)
    return memo[jug]
""", {3: 1, 4: 1, 5: 1, 10: 1, 13: 1, 17: 1, 20: 3}, 11),
    "machine_schedule": ("""
import heapq

def soonest(jobs, machines):
    free_at = [0] * machines
    for length in jobs:
        start = heapq.heappop(free_at)
        heapq.heappush(free_at, start + length)
    return max(free_at)
""", {1: 1, 2: 1, 6: 1, 17: 1, 20: 2}, 20),
    "mirror_spans": ("""
def mirror_spans(text):
    size = len(text)
    spans = [[False] * size for _ in range(size)]
    total = 0
    for start in range(size - 1, -1, -1):
        for stop in range(start, size):
            inner = stop - start < 2 or spans[start + 1][stop - 1]
            spans[start][stop] = inner and text[start] == text[stop]
            total += spans[start][stop]
    return total
""", {1: 2, 2: 2, 12: 1, 13: 2, 17: 1, 20: 1}, 16),
    "parity_bits": ("""
def parity(flags):
    odd = 0
    for flag in flags:
        odd ^= flag & 1
    return odd
""", {1: 1, 2: 1, 17: 1, 20: 1, 22: 1}, 20),
    "zip_chains": ("""
def zip_chains(one, two):
    head = one
    while one and two:
        after_one = one.next
        after_two = two.next
        one.next = two
        two.next = after_one or after_two
        one = after_one
        two = after_two
    return head
""", {1: 1, 2: 1, 17: 1, 20: 2, 23: 1, 26: 1}, 20),
    "count_leaves": ("""
def count_leaves(twig):
    if twig.left is None and twig.right is None:
        return 1
    return sum(count_leaves(part) for part in (twig.left, twig.right) if part)
""", {3: 1, 4: 1, 17: 1, 20: 1, 27: 1}, 10),
    "account_book": ("""
def balances(moves, opening):
    book = [opening]
    for day, move in enumerate(moves):
        book.append(opening)
        book[day + 1] = book[day] + move
    return book
""", {1: 1, 2: 1, 13: 1, 17: 1, 20: 2, 28: 1}, 20),
    "round_trips": ("""
def round_trips(roads, home):
    trips = []
    trail = [home]

    def drive(town):
        if home in roads[town]:
            trips.append(list(trail))
        for onward in roads[town]:
            if onward not in trail:
                trail.append(onward)
                drive(onward)
                trail.pop()

    drive(home)
    return trips
""", {1: 1, 2: 1, 3: 1, 4: 1, 13: 1, 17: 2, 18: 1, 20: 2, 29: 1}, 7),
    "teams": ("""
class Teams:
    def __init__(self):
        self.link = {}

    def find_captain(self, player):
        boss = self.link.get(player, player)
        return player if boss == player else self.find_captain(boss)

    def union_teams(self, one, two):
        self.link[self.find_captain(one)] = self.find_captain(two)
""", {3: 1, 4: 1, 13: 1, 17: 3, 20: 3, 30: 1}, 2),
    "skip_ahead": ("""
def skip_ahead(link, hops):
    for _ in range(hops):
        if link.next is None:
            return None
        link = link.next.next
    return link
""", {1: 1, 2: 1, 17: 1, 18: 1, 19: 1, 20: 2, 23: 1, 31: 1}, 4),
    "login_burst": ("""
def busiest(stamps, span):
    oldest = 0
    peak = 0
    for newest, stamp in enumerate(stamps):
        while stamp - stamps[oldest] > span:
            oldest += 1
        peak = max(peak, newest - oldest)
    return peak
""", {1: 2, 2: 2, 13: 1, 17: 1, 20: 2, 32: 1}, 5),
    "smallest_number": ("""
def smallest_number(digits, drop):
    kept = []
    for digit in digits:
        while drop and kept and kept[-1] > digit:
            kept.pop()
            drop -= 1
        kept.append(digit)
    return kept[:len(kept) - drop]
""", {1: 2, 2: 2, 13: 1, 17: 1, 20: 2, 33: 1}, 6),
    "build_waves": ("""
from collections import deque

def build_waves(needs):
    indegree = {job: len(before) for job, before in needs.items()}
    ready = deque(job for job, k in indegree.items() if not k)
    waves = 0
    while ready:
        for _ in range(len(ready)):
            built = ready.popleft()
            for job in needs:
                if built in needs[job]:
                    indegree[job] -= 1
                    if not indegree[job]:
                        ready.append(job)
        waves += 1
    return waves
""", {1: 3, 2: 3, 7: 1, 13: 1, 17: 1, 18: 2, 20: 1, 34: 1}, 3),
    "mirror_board": ("""
def mirror_board(board):
    wide = len(board[0])
    for row in range(len(board)):
        for col in range(wide // 2):
            board[row][col], board[row][wide - 1 - col] = board[row][wide - 1 - col], board[row][col]
    return board
""", {1: 2, 2: 2, 12: 1, 13: 2, 14: 1, 17: 1, 20: 1, 35: 1}, 16),
    "check_digit": ("""
def check_digit(code):
    total = 0
    for place, digit in enumerate(code):
        if place % 2:
            digit *= 3
        total += digit
    return total % 10
""", {1: 1, 2: 1, 17: 1, 18: 1, 20: 1, 36: 1}, 20),
    "tower_moves": ("""
def tower_moves(disks):
    if disks == 0:
        return 0
    return tower_moves(disks - 1) + 1 + tower_moves(disks - 1)
""", {3: 1, 4: 2, 17: 1, 20: 1}, 12),
    "common_count": ("""
def common_count(one, two):
    if len(one) > 8:
        return common_count(one[:8], two) + common_count(one[8:], two)
    a = b = hits = 0
    while a < len(one) and b < len(two):
        if one[a] == two[b]:
            hits += 1
        ahead = one[a] <= two[b]
        b += one[a] >= two[b]
        a += ahead
    return hits
""", {1: 1, 2: 1, 3: 1, 4: 2, 13: 1, 17: 1, 18: 1, 20: 2, 38: 1}, 8),
    "shake_down": ("""
def shake(row, first, last):
    if last - first < 1:
        return
    for step in range(first, last):
        if row[step] > row[step + 1]:
            row[step], row[step + 1] = row[step + 1], row[step]
    shake(row, first, last - 1)
    shake(row, first + 1, last)
""", {1: 1, 2: 1, 3: 1, 4: 2, 13: 1, 14: 1, 17: 1, 18: 1, 20: 3}, 9),
    "uf_parent_only": ("""
def find_owner(parent, item):
    for _ in parent:
        item = parent.get(item, item)
    return item
""", {1: 1, 2: 1, 17: 1, 20: 2, 30: 1}, 2),
    "defaultdict_and_set_literal": ("""
from collections import defaultdict

def group(pairs):
    buckets = defaultdict(list)
    tags = {1, 2}
    for k, v in pairs:
        buckets[k].append(v)
    return buckets, tags
""", {1: 1, 2: 1, 9: 1, 10: 1, 13: 1, 17: 1, 20: 1}, 20),
    "class_children": ("""
class Node:
    def __init__(self):
        self.children = []
""", {17: 1, 20: 1, 27: 1}, 22),
    "two_pointer_other_names": ("""
def scan(a, b):
    x, y = 0, len(a) - 1
    while x < y:
        x += 1
    return x
""", {1: 1, 2: 1, 17: 1, 20: 2}, 20),
    "monotonic_in_for": ("""
def f(xs):
    st = []
    for x in xs:
        while st and st[-1] > x:
            st.pop()
        st.append(x)
    return st
""", {1: 2, 2: 2, 13: 1, 17: 1, 20: 1, 33: 1}, 6),
    "indegree_underscore": ("""
from collections import deque

def order(n):
    in_degree = [0] * n
    q = deque()
    return q, in_degree
""", {7: 1, 17: 1, 20: 1, 34: 1}, 3),
    "memo_by_name": ("""
def ways(n, cache=None):
    if n < 2:
        return 1
    dp_table = {}
    return ways(n - 1) + ways(n - 2)
""", {3: 1, 4: 2, 5: 1, 10: 1, 17: 1, 20: 2}, 11),
    "ll_insert_class_later": ("""
def append_car(train, load):
    train.next = Car(load)
    return train

class Car:
    def __init__(self, load):
        self.load = load
        self.next = None
""", {17: 2, 20: 2, 23: 1, 24: 1}, 22),
    "posonly_defaults": ("""
def f(a, /, b=[], c={}):
    return b

def g(a, b=1, /, c=[]):
    return c
""", {10: 1, 17: 2, 20: 1}, 22),
    "posonly_quirk": ("""
def g(a, b=1, /, c=[]):
    return c
""", {17: 1, 20: 1}, 22),
    # ---- edge shapes ---------------------------------------------------------
    "empty": ("", {}, 22),
    "blank": ("   \n\t\n", {}, 22),
    "async_only": ("""
async def walk(xs):
    async for x in xs:
        pass
""", {}, 22),
    "for_else_return": ("""
def f(xs):
    for x in xs:
        pass
    else:
        return 1
""", {1: 1, 2: 1, 17: 1, 19: 1, 20: 1}, 20),
    "def_in_loop": ("""
def outer(xs):
    for x in xs:
        def inner(y):
            return y
        inner(x)
""", {1: 1, 2: 1, 17: 2, 19: 1, 20: 1}, 20),
    "elif_chain": ("""
def grade(xs):
    for x in xs:
        if x > 90:
            a = 1
        elif x > 80:
            a = 2
        elif x > 70:
            a = 3
        elif x > 60:
            a = 4
""", {1: 1, 2: 1, 17: 1, 18: 4, 20: 1}, 20),
    "list_default": ("""
def keep(a, acc=[]):
    return acc
""", {10: 1, 17: 1, 20: 2}, 22),
    "method_self_call": ("""
class A:
    def walk(self):
        return self.walk()
""", {3: 1, 4: 1, 17: 1, 20: 1}, 21),
    "same_named_methods": ("""
class A:
    def go(self, n):
        return self.go(n - 1)

class B:
    def go(self, n):
        return self.go(n - 1)
""", {3: 1, 4: 2, 17: 2, 20: 2}, 12),
    "set_union": ("""
def u(a, b):
    return a | b
""", {17: 1, 20: 2, 22: 1}, 22),
    "squeeze_blanks": ("""
def squeeze_blanks(letters):
    end = 0
    for letter in letters:
        if letter != " " or end == 0:
            letters[end] = letter
            end += 1
    return letters[:end]
""", {1: 1, 2: 1, 13: 1, 17: 1, 18: 1, 20: 1, 37: 1}, 15),
    "crossing": ("""
def crossing(rise, fall):
    up = 0
    down = len(fall)
    while up < len(rise) and down > 0:
        if rise[up] > fall[down - 1]:
            return up
        up += 1
        down -= 1
    return -1
""", {1: 1, 2: 1, 13: 1, 17: 1, 18: 1, 19: 1, 20: 2, 38: 1}, 15),
    "ll_insert": ("""
class Stop:
    def __init__(self, title):
        self.title = title
        self.next = None

def detour(stop, title):
    extra = Stop(title)
    extra.next = stop.next
    stop.next = extra
    return stop
""", {17: 2, 20: 2, 23: 1, 24: 1}, 22),
    "ll_delete": ("""
def thin_out(link):
    while link and link.next:
        link.next = link.next.next
        link = link.next
""", {1: 1, 2: 1, 17: 1, 20: 1, 23: 1, 25: 1, 31: 1}, 4),
}

SYNTAX_ERRORS = {
    "syntax_error": "def f(:\n    pass\n",
    "nul_byte": "x = 1\x00\n",
}
