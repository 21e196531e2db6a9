"""Plain Python answers for small inputs."""

import math


def near(points, radius):
    """Ordered pairs of different rows within the radius; points are (key, x, y, ...)."""
    return {(a[0], b[0]) for a in points for b in points
            if a[0] != b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= radius * radius}


def nearest(queries, points, k, skip_self=False):
    out = set()
    for q in queries:
        order = sorted(((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2, p[0]) for p in points
                       if not (skip_self and p[0] == q[0]))
        out |= {(q[0], key, rank) for rank, (_, key) in enumerate(order[:k], 1)}
    return out


def inside(x, y, edges):
    hits = 0
    for x1, y1, x2, y2 in edges:
        if y1 > y2:
            x1, y1, x2, y2 = x2, y2, x1, y1
        if y1 <= y < y2 and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hits += 1
    return hits % 2 == 1


def haversine(lon1, lat1, lon2, lat2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = (math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2)
         * math.sin(math.radians(lon2 - lon1) / 2) ** 2)
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1.0, h)))


def dbscan(points, eps, min_points):
    keys = [p[0] for p in points]
    links = {k: {k} for k in keys}
    for a, b in near(points, eps):
        links[a].add(b)
    core = {k for k in keys if len(links[k]) >= min_points}
    label = {}
    for k in sorted(core):
        if k in label:
            continue
        todo = [k]
        while todo:
            v = todo.pop()
            if v in label:
                continue
            label[v] = k
            todo += [u for u in links[v] if u in core and u not in label]
    for k in keys:
        if k not in core:
            around = [label[u] for u in links[k] if u in core]
            label[k] = min(around) if around else None
    return {(k, label[k], k in core) for k in keys}
