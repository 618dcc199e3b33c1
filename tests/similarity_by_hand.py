"""Similarities by definition, a pair at a time: what the batch forms are held against."""


def jaro_winkler_one(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity, raised by up to four common first characters where it is above 0.7 (Winkler 1990)."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [b[j] for j in range(len(b)) if used[j]]
    moved = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + same * weight * (1 - jaro)


def token_sort_one(a: str, b: str) -> float:
    """Twice the longest common subsequence of the sorted tokens over both lengths."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for c in a:
        corner = 0
        for j, d in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if c == d else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))
