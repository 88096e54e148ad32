"""The greedy palette against a plain reading of its rules."""

from collections import defaultdict

from reelframe.operators import images


def brute(pixels):
    boxes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0, 0]))
    for p in pixels:
        box = boxes[p.image_id][p.r >> 3 << 10 | p.g >> 3 << 5 | p.b >> 3]
        for k, v in enumerate((1, p.r, p.g, p.b)):
            box[k] += v
    for image, found in boxes.items():
        most = max(n for n, *_ in found.values())
        shades = {}
        for key, (n, *rgb) in found.items():
            mean = [c / n for c in rgb]
            high, low = max(mean) / 255, min(mean) / 255
            light = (high + low) / 2
            shades[key] = (n, mean, 0 if high == low else (high - low) / (1 - abs(2 * light - 1)), light)
        taken = {}
        for name, s0, s1, s2, l0, l1, l2 in images.TARGETS:
            fit = [(-round((3 * (1 - abs(s - s1)) + 6.5 * (1 - abs(light - l1)) + 0.5 * n / most) / 10, 9), key) for key, (n, _, s, light) in shades.items() if key not in taken and s0 <= s <= s2 and l0 <= light <= l2]
            if fit:
                taken[min(fit)[1]] = name
        kept = []
        for key in sorted(taken, key=lambda k: (max(shades[k][1]) + min(shades[k][1]), shades[k][1])):
            if len(kept) < 5 and (not kept or sum((a - b) ** 2 for a, b in zip(shades[key][1], kept[-1], strict=True)) >= 900):
                kept.append(shades[key][1])
        yield image, {(name, key) for key, name in taken.items()}, kept


def test_palette(spark):
    pixels = spark.sql("SELECT id % 12 AS image_id, id AS y, 0 AS x, cast(id * 37 % 256 AS int) AS r, cast(id * id % 251 AS int) AS g, cast(id * 13 % 256 AS int) AS b FROM range(6000)")
    picked = images.palette(images.shaded(images.histogram(pixels)))
    got, colours = defaultdict(set), defaultdict(list)
    for r in picked.collect():
        got[r.image_id].add((r.target, r.key))
    for r in images.distinct_colours(picked).orderBy("image_id", "place").collect():
        colours[r.image_id].append([r.r, r.g, r.b])
    for image, taken, kept in brute(pixels.collect()):
        assert got[image] == taken
        assert len(colours[image]) == len(kept) and all(abs(a - b) < 1e-9 for x, y in zip(colours[image], kept, strict=True) for a, b in zip(x, y, strict=True))
