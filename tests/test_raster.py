import numpy as np

from atelier.functions import raster as r


def mask(*rows):
    return np.array([[c == "#" for c in row] for row in rows])


def test_morphology():
    m = mask(".....", ".###.", ".#.#.", ".###.", ".....")
    assert r.dilate(m).all() and r.close(m)[2, 2] and r.erode(m).sum() == 0
    assert r.erode(np.ones((3, 3), bool)).all()


def test_label_against_flood_fill():
    rng = np.random.default_rng(3)
    for diagonal in (True, False):
        for _ in range(20):
            m = rng.random((12, 15)) < 0.45
            got, seen = r.label(m, diagonal), np.zeros(m.shape, int)
            n = 0
            for y, x in zip(*np.nonzero(m), strict=True):
                if not seen[y, x]:
                    n += 1
                    todo = [(y, x)]
                    while todo:
                        a, b = todo.pop()
                        if 0 <= a < 12 and 0 <= b < 15 and m[a, b] and not seen[a, b]:
                            seen[a, b] = n
                            todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not i or not j]
            assert (got == seen).all()


def test_thinning_and_skeleton_keep_shape():
    bar = np.zeros((9, 30), bool)
    bar[2:7, 3:27] = True
    line = r.thin(bar)
    assert line.sum() < 30 and r.label(line).max() == 1 and (line & ~bar).sum() == 0
    assert (r.skeleton(bar) & ~bar).sum() == 0 and r.skeleton(bar).any()


def test_rooms_leave_out_what_touches_the_border():
    b = np.zeros((40, 40), bool)
    b[5, 5:35] = b[34, 5:35] = b[5:35, 5] = b[5:35, 34] = b[5:35, 20] = True
    got = r.rooms(b, least=100)
    assert got.max() == 2 and got[0, 0] == 0 and got[10, 10] != got[10, 30]


def test_polygons():
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    assert r.ring_area(square) == 16 and r.fill_polygon(square + 1, 8, 8).sum() == 16
    assert abs(r.convex_iou(square, square + [2, 0]) - 8 / 24) < 1e-12 and r.convex_iou(square, square + 10) == 0
    assert abs(r.convex_iou(square, square[::-1]) - 1) < 1e-12
    turn = np.array([[np.cos(0.5), -np.sin(0.5)], [np.sin(0.5), np.cos(0.5)]])
    long, short, angle = r.least_rectangle(np.array([[0, 0], [10, 0], [10, 3], [0, 3], [5, 1]]) @ turn.T)
    assert abs(long - 10) < 1e-9 and abs(short - 3) < 1e-9 and abs(angle - np.degrees(0.5)) < 1e-6
    assert r.simplify(np.array([[0, 0], [1, 0.1], [2, 0], [2, 5]], float), 0.5).tolist() == [[0, 0], [2, 0], [2, 5]]


def test_distance_transform_against_brute_force():
    m = np.random.default_rng(2).random((9, 11)) < 0.8
    off = np.argwhere(~m)
    want = np.array([[np.hypot(*(off - [y, x]).T).min() for x in range(11)] for y in range(9)])
    assert np.allclose(r.distance_transform(m), want)
    assert np.isinf(r.distance_transform(np.ones((3, 3), bool))).all()


def test_hashes_bear_small_changes():
    g = np.random.default_rng(4).random((90, 120)) * 20 + np.linspace(0, 200, 120) * np.sin(np.arange(90) / 9)[:, None]
    assert (r.difference_hash(g) ^ r.difference_hash(g + 3)).bit_count() == 0
    assert (r.perceptual_hash(g) ^ r.perceptual_hash(g * 1.01)).bit_count() <= 2
    assert (r.perceptual_hash(g) ^ r.perceptual_hash(g[::-1])).bit_count() > 10


def test_map_images(spark):
    m = mask("##..", "##..", "...#")
    df = spark.createDataFrame([(7, bytearray(m.astype(np.uint8).tobytes()), 4)], "image long, pixels binary, width int")
    kernel = lambda a: [(int(k), int(n)) for k, n in enumerate(np.bincount(r.label(a > 0).ravel())) if k]
    assert [tuple(x) for x in r.map_images(df, kernel, "label int, n int").collect()] == [(7, 1, 4), (7, 2, 1)]
