"""Plain versions of the operators' contracts, for small tables."""

from collections import defaultdict


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, size):
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_links(sets, percent):
    """All pairs with 100 * |A n B| >= percent * |A u B|; by prefix filtering, which loses none."""
    often = defaultdict(int)
    for s in sets.values():
        for x in s:
            often[x] += 1
    seen, out = defaultdict(list), []
    for i, s in sets.items():
        if not s:
            continue
        n = len(s)
        keep = n - -(-n * percent // 100) + 1
        done = set()
        for x in sorted(s, key=lambda x: (often[x], x))[:keep]:
            for j in seen[x]:
                if j not in done:
                    done.add(j)
                    both = len(s & sets[j])
                    if 100 * both >= percent * (n + len(sets[j]) - both):
                        out.append((j, i))
            seen[x].append(i)
    return out
