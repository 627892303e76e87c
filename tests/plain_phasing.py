"""A plain model of graph phasing on one whole chromosome: words are strings, tables are dicts, nothing is split into islands."""

from collections import defaultdict

FLIP = str.maketrans("01", "10")


class Chromosome:
    """reads: lists of (variant, allele) in order, -1 for a gap."""

    def __init__(self, reads, k, n=None):
        self.k, self.reads = k, [r for r in map(trimmed, reads) if len(r) > 1]
        self.n = n or 1 + max((r[-1][0] for r in self.reads), default=-1)
        self.last = self.n - k  # the last rank with a node
        words = {m: self.counted(m) for m in {2, k, k + 1}}
        self.count, self.weight = words[k], dict(words[k + 1])
        self.patch()
        self.trim()
        self.drop_lone_nodes()
        self.hint = self.hints(words[2])

    def counted(self, m):
        out = defaultdict(int)
        for read in self.reads:
            for i in range(len(read) - m + 1):
                part = read[i : i + m]
                if all(a >= 0 for _, a in part):
                    word = "".join(str(a) for _, a in part)
                    out[part[0][0], word] += 1
                    out[part[0][0], word.translate(FLIP)] += 1
        return dict(out)

    def patch(self):
        for s in range(self.last):
            if any(rank == s for rank, _ in self.weight):
                continue
            made = [((c + self.count[s + 1, u[1:] + b]) // 2, u + b) for (rank, u), c in self.count.items() if rank == s for b in "01" if (s + 1, u[1:] + b) in self.count]
            if made:
                weight, word = min(made, key=lambda x: (-x[0], x[1]))
                self.weight[s, word] = self.weight[s, word.translate(FLIP)] = weight

    def trim(self):
        most = defaultdict(int)
        for (s, _), w in self.weight.items():
            most[s] = max(most[s], w)
        self.weight = {(s, e): w for (s, e), w in self.weight.items() if w * (2 if most[s] >= 15 else 5) >= most[s]}

    def drop_lone_nodes(self):
        touched = {x for s, e in self.weight for x in ((s, e[:-1]), (s + 1, e[1:]))}
        self.count = {x: c for x, c in self.count.items() if x in touched}

    def hints(self, pairs):
        same = lambda s: sum(pairs.get((s, w), 0) for w in ("00", "11")) // 2
        diff = lambda s: sum(pairs.get((s, w), 0) for w in ("01", "10")) // 2
        every = [(s, same(s) + diff(s), abs(same(s) - diff(s))) for s in range(self.n - 1)]
        thin = [s for s, total, _ in every if total < 5]
        limit = max([d for d in range(6, 20) if 100 * (len(thin) + sum(gap <= d for _, _, gap in every)) < 5 * self.n], default=5)
        doubtful = {*thin, *(s for s, _, gap in every if gap < limit)}
        return {t: 1 for s in doubtful for t in (s, s + 1)}

    # One step along the graph; right leads to higher variants.

    def steps(self, s, word, right):
        """{bit: (weight, edge, node it leads to)} of the live edges on one side of a node."""
        out = {}
        for bit in "01":
            edge = (s, word + bit) if right else (s - 1, bit + word)
            if edge in self.weight:
                out[bit] = self.weight[edge], edge, (s + 1, (word + bit)[1:]) if right else (s - 1, (bit + word)[:-1])
        return out

    def cut(self, edge):
        del self.weight[edge]
        self.weight.pop((edge[0], edge[1].translate(FLIP)), None)

    def inside(self, s, right):
        return s < self.last if right else s > 0

    # Tips.

    def remove_tips(self):
        starts = sorted(f"{w:0{self.k}b}" for w in range(1 << (self.k - 1)))
        for right, ranks in ((True, range(self.last, -1, -1)), (False, range(self.last + 1))):
            for s in ranks:
                for word in starts:
                    self.tip(s, word, right)
        self.drop_lone_nodes()

    def tip(self, s, word, right):
        fork = self.steps(s, word, right)
        if len(fork) < 2:
            return
        length, plain = {}, {}
        for bit in "01":
            (at, node), length[bit], plain[bit] = fork[bit][2], 0, True
            while self.inside(at, right) and length[bit] <= 15:
                ahead = self.steps(at, node, right)
                plain[bit] &= len(self.steps(at, node, not right)) < 2
                if not ahead:
                    break
                plain[bit] &= len(ahead) < 2
                at, node = max(ahead.items(), key=lambda x: (x[1][0], x[0]))[1][2]
                length[bit] += 1
        gone = next((b for b, o in ("10", "01") if plain[b] and length[b] < 5 and length[o] > 15), None)
        if gone is None:
            return
        support = {}
        for bit in "01":
            support[bit], (at, node) = fork[bit][0], fork[bit][2]
            for _ in range(min(length.values())):
                ahead = self.steps(at, node, right)
                support[bit] += ahead["0"][0] if "0" in ahead else ahead["1"][0] if ahead else 0
                at, node = max(ahead.items(), key=lambda x: (x[1][0], x[0]))[1][2]
        doubtful = any(plain[b] and support[o] < 1.5 * support[b] for b, o in ("01", "10"))
        chain, (at, node) = [fork[gone][1]], fork[gone][2]
        marks = {s}
        self.cut(chain[0])
        while self.inside(at, right):
            marks.add(at)
            ahead = self.steps(at, node, right)
            if not ahead:
                break
            _, edge, (at, node) = next(iter(ahead.values()))
            self.cut(edge)
        if doubtful:
            self.hint.update({t: 2 for t in marks})

    # Undecided areas.

    def areas(self):
        kinds = defaultdict(set)
        for s, e in self.weight:
            if e[0] == "0":
                for j in range(self.k):
                    kinds[s + j + 1].add(e[j] == e[j + 1])
        out = []
        for t in sorted(t for t, kind in kinds.items() if len(kind) == 2):
            over = [r for r in self.reads if r[0][0] < t <= r[-1][0]]
            left, right = min(r[0][0] for r in over), max(r[-1][0] for r in over)
            if out and left <= out[-1]["pair"]:
                out[-1].update(left=min(out[-1]["left"], left), right=max(out[-1]["right"], right), pair=t)
            else:
                out.append({"left": left, "right": right, "pair": t, "reads": []})
            out[-1]["reads"] += [r for r in over if not any(r is o for o in out[-1]["reads"])]
        return out

    def solve_areas(self):
        """Close all areas from left to right; then keep one path in each, the enumerable ones first."""
        self.solved = areas = self.areas()
        kept = {}
        every = [f"{w:0{self.k}b}" for w in range(1 << self.k)]
        for area in areas:
            for s in range(area["left"], area["right"] - self.k + 2):
                for word in every:
                    for right, may in ((False, s > area["left"]), (True, s + self.k - 1 < area["right"])):
                        if may and (s, word) in self.count and not self.steps(s, word, right):
                            for bit in "01":
                                edge, node = ((s, word + bit), (s + 1, (word + bit)[1:])) if right else ((s - 1, bit + word), (s - 1, (bit + word)[:-1]))
                                if node in self.count:
                                    self.weight[edge] = self.weight[edge[0], edge[1].translate(FLIP)] = 1
            for s in range(area["left"], area["right"] - self.k + 1):
                for e in self.words_of(s, kept):
                    del kept[s, e]
                kept.update({(s, e): self.weight[s, e] for e in self.words_of(s, self.weight)})
            area["ways"] = self.ways(area)
        for area in sorted(areas, key=lambda a: not 0 < a["ways"] < 256):
            (self.enumerate if 0 < area["ways"] < 256 else self.heaviest)(area, kept)

    @staticmethod
    def words_of(s, table):
        return [e for rank, e in list(table) if rank == s]

    def ways(self, area):
        ends = {word: 1 for s, word in self.count if s == area["left"]}
        for s in range(area["left"], area["right"] - self.k + 1):
            now = defaultdict(int)
            for e in self.words_of(s, self.weight):
                now[e[1:]] += ends.get(e[:-1], 0)
            ends = now
        return sum(c for word, c in ends.items() if word[0] == "0")

    def clear(self, area):
        for s in range(area["left"], area["right"] - self.k + 1):
            for e in self.words_of(s, self.weight):
                del self.weight[s, e]

    def keep(self, s, e, kept):
        for word in (e, e.translate(FLIP)):
            if (s, word) in kept:
                self.weight[s, word] = kept[s, word]

    def enumerate(self, area, kept):
        paths = sorted(word for s, word in self.count if s == area["left"] and word[0] == "0")
        for s in range(area["left"], area["right"] - self.k + 1):
            paths = [p + b for p in paths for b in "01" if (s, p[-self.k :] + b) in self.weight]
        if not paths:
            return

        def cost(path):
            wrong = [[int(path[t - area["left"]]) != a for t, a in r if a >= 0] for r in area["reads"]]
            return sum(min(sum(x), len(x) - sum(x)) for x in wrong)

        best = min(paths, key=cost)
        self.clear(area)
        for s in range(area["left"], area["right"] - self.k + 1):
            self.keep(s, best[s - area["left"] :][: self.k + 1], kept)

    def heaviest(self, area, kept):
        total, back = defaultdict(int), {}
        for s in range(area["left"] + 1, area["right"] - self.k + 2):
            for e in sorted(self.words_of(s - 1, self.weight)):  # by the bit in front
                if (got := total[s - 1, e[:-1]] + self.weight[s - 1, e]) > total[s, e[1:]]:
                    total[s, e[1:]], back[s, e[1:]] = got, e
        self.clear(area)
        s = area["right"] - 1
        while s > area["left"]:
            here = sorted((-total[s, w], w) for rank, w in list(total) if rank == s)
            word = here[0][1] if here and here[0][0] else None
            while word is not None and (s, word) in back:
                e = back[s, word]
                self.keep(s - 1, e, kept)
                s, word = s - 1, e[:-1]
            s -= self.k
        self.hint.update({t: 3 for t in range(area["left"], area["right"] + 1)})

    def blocks(self):
        out = []
        for s, word in sorted(self.count):
            if word[0] == "0" and not self.steps(s, word, False) and len(self.steps(s, word, True)) == 1:
                phases, at = word, (s, word)
                while ahead := self.steps(*at, True):
                    bit, (_, _, at) = next(iter(ahead.items()))
                    phases += bit
                out.append((s, [int(c) for c in phases]))
        return out


    # Bubbles between linear flanks.

    def flank(self, s, word, right):
        """The alleles along linear edges from a node on, node after node, the nearest first."""
        out = ""
        while len(out) < 64:
            ahead = self.steps(s, word, right)
            if len(ahead) != 1:
                break
            bit, (_, _, (t, other)) = next(iter(ahead.items()))
            if len(self.steps(t, other, not right)) != 1:
                break
            out, s, word = out + bit, t, other
        return out

    def solve_bubbles_by_shape(self):
        """(first rank, word, variants, ways, reads, errors, path) of every bubble, from left to right."""
        nodes = {x for s, e in self.weight for x in ((s, e[:-1]), (s + 1, e[1:]))}
        back = {x: self.flank(*x, False)[::-1] for x in nodes}
        ahead = {x: self.flank(*x, True) for x in nodes}
        seen, out = set(), []
        for s, word in sorted(x for x in nodes if x[1][0] == "0"):
            if (s, word) in seen or len(self.steps(s, word, True)) < 2 or len(back[s, word]) < 10:
                continue
            seen.add((s, word))
            ways, dead, closed = [word], [], False
            for t in range(s, s + 30):
                steps = [(p, self.steps(t, p[-self.k :], True)) for p in ways]
                for p, own in steps:
                    seen.add((t + 1, (p[-self.k :] + ("0" if "0" in own else "1"))[1:]))
                dead += [p for p, own in steps if not own]
                ways = [p + bit for p, own in steps for bit in sorted(own)]
                if not ways or len(ways) > 256:
                    break
                if closed := all(len(ahead.get((t + 1, p[-self.k :]), "")) >= 10 for p in ways):
                    break
            if not closed:
                continue
            base = s - len(back[s, word])
            paths = [back[s, word] + p + ahead[t + 1, p[-self.k :]] for p in ways]
            words = lambda at, p: [(at + j, p[j : j + self.k + 1]) for j in range(len(p) - self.k)]
            if any(e not in self.weight for p in paths for e in words(base, p)):
                continue
            for p in dead:
                for e in words(s, p):
                    self.drop(e)
            size, on = len(ways[0]), []
            for j in range(size):
                kinds = {p[i] == p[i + 1] for p in ways for i in (j - 1,) if i >= 0}, {p[j] == p[j + 1] for p in ways if j + 1 < size}
                if any(len(kind) == 2 for kind in kinds):
                    on += [r for r in self.reads if (s + j, 0) in r or (s + j, 1) in r]
            on = [r for n, r in enumerate(on) if not any(r is o for o in on[:n])]
            high = min(s + size + 128, base + min(map(len, paths)))
            if not on or any(r[0][0] < base or r[-1][0] >= high for r in on):
                continue
            cost = []
            for p in paths:
                wrong = [[int(p[t - base]) != a for t, a in r if a >= 0] for r in on]
                cost.append(sum(min(sum(x), len(x) - sum(x)) for x in wrong))
            for p in paths:
                for e in words(base, p):
                    self.drop(e)
            best = paths[cost.index(min(cost))]
            for s_, e in words(base, best):
                self.weight[s_, e] = self.weight[s_, e.translate(FLIP)] = 1
            out.append((s, int(word, 2), size, len(ways), len(on), min(cost), best))
        return out

    def drop(self, edge):
        self.weight.pop(edge, None)
        self.weight.pop((edge[0], edge[1].translate(FLIP)), None)


def trimmed(read):
    called = [i for i, (_, a) in enumerate(read) if a >= 0]
    return read[called[0] : called[-1] + 1] if called else []
