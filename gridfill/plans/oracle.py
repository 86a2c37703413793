"""SQL building blocks for the DuckDB side of the correctness check."""

LAT = "46e0 + CAST(({k}*7919)%5000 AS DOUBLE)/CAST(1000 AS DOUBLE)"
LON = "-60e0 + CAST(({k}*104729)%7000 AS DOUBLE)/CAST(1000 AS DOUBLE)"


def lat(key: str) -> str:
    return LAT.format(k=key)


def lon(key: str) -> str:
    return LON.format(k=key)


ORDERS = f"""s AS (SELECT 'demo' AS datasetName, o_orderkey AS index, {lat('o_orderkey')} AS lat, {lon('o_orderkey')} AS lon,
  o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS cust FROM orders),
lng AS (SELECT datasetName, index, lat, lon, 'price' AS name, price AS value FROM s WHERE price IS NOT NULL
  UNION ALL SELECT datasetName, index, lat, lon, 'cust', cust FROM s WHERE cust IS NOT NULL)"""

CUSTOMERS = f"""c AS (SELECT 'customers' AS datasetName, c_custkey AS index, {lat('c_custkey')} AS lat, {lon('c_custkey')} AS lon,
  c_mktsegment AS region, c_acctbal AS balance FROM customer)"""

SUPPLIERS = f"""s AS (SELECT 'suppliers' AS datasetName, s_suppkey AS index, {lat('s_suppkey')} AS lat, {lon('s_suppkey')} AS lon,
  s_acctbal AS balance FROM supplier),
lng AS (SELECT datasetName, index, lat, lon, 'balance' AS name, balance AS value FROM s WHERE balance IS NOT NULL)"""


def spec(g: float) -> str:
    return f"""spec0 AS (SELECT CAST({g} AS DOUBLE) AS g, CAST({g} AS DOUBLE)/111 AS lat_gap,
  CAST({g} AS DOUBLE)/(111*cos(pi()*48.5e0/180)) AS lon_gap),
spec AS (SELECT *, CAST(ceil(5e0/lat_gap) AS BIGINT) AS x_num, CAST(ceil(7e0/lon_gap) AS BIGINT) AS y_num FROM spec0)"""


BOXED = """boxed AS (SELECT l.*, CAST(floor((lat-46e0)/lat_gap) AS BIGINT) AS bx, CAST(floor((lon- -60e0)/lon_gap) AS BIGINT) AS gy,
  CAST(floor((lat-46e0)/lat_gap) AS BIGINT)*y_num + CAST(floor((lon- -60e0)/lon_gap) AS BIGINT) AS box_index FROM lng l, spec)"""

MEANS = """means AS (SELECT datasetName, name, bx, gy, box_index AS index, 46e0 + lat_gap/2 + bx*lat_gap AS lat,
  -60e0 + lon_gap/2 + gy*lon_gap AS lon, v AS value
  FROM (SELECT datasetName, name, bx, gy, box_index, avg(value) AS v FROM boxed GROUP BY ALL), spec)"""

BOXES = """boxes AS (SELECT CAST(i // y_num AS BIGINT) AS box_x, CAST(i % y_num AS BIGINT) AS box_y, CAST(i AS BIGINT) AS box_index,
  46e0 + lat_gap/2 + (i // y_num)*lat_gap AS box_lat, -60e0 + lon_gap/2 + (i % y_num)*lon_gap AS box_lon
  FROM spec, unnest(range(x_num*y_num)) AS u(i))"""

TARGETS = """feats AS (SELECT DISTINCT datasetName, name FROM means),
targets AS (SELECT f.datasetName, f.name, b.* FROM boxes b, feats f
  WHERE NOT EXISTS (SELECT 1 FROM means m WHERE m.datasetName=f.datasetName AND m.name=f.name AND m.index=b.box_index))"""


def prelude(source: str = ORDERS, g: float = 8.0) -> str:
    return ", ".join([source, spec(g), BOXED, MEANS, BOXES, TARGETS])


PAIRS = """pairs AS (SELECT t.name, t.box_index, t.box_x, t.box_y, t.box_lat, t.box_lon, m.index, m.value, m.lat, m.bx, m.gy,
  sqrt(((m.bx-t.box_x)*lat_gap)*((m.bx-t.box_x)*lat_gap) + ((m.gy-t.box_y)*lon_gap)*((m.gy-t.box_y)*lon_gap)) AS dist
  FROM targets t JOIN means m ON m.name=t.name, spec)"""


def knn(k: int, source: str = ORDERS, g: float = 8.0) -> str:
    """CTEs up to nn: (name, box_index, box_lat, box_lon, index, value, dist, rn) with rn <= k."""
    return f"""{prelude(source, g)}, {PAIRS},
nn AS (SELECT * FROM (SELECT name, box_index, box_lat, box_lon, index, value, dist,
  row_number() OVER (PARTITION BY name, box_index ORDER BY dist, index) AS rn FROM pairs) WHERE rn <= {k})"""


ALPHA = "round(2*6371e0*asin(cos(radians(floor(abs({lat}))))*sin(radians(0.5e0))), 4)"


def ring(k: int, need: int, base: int, top: int = 7) -> str:
    """CTEs up to rnn: nearest k by the km metric inside the first ring with `need` samples."""
    within = " ".join(
        f"WHEN abs(floor((bx+0.5e0)/{2**l})-floor((box_x+0.5e0)/{2**l}))<=1 AND abs(floor((gy+0.5e0)/{2**l})-floor((box_y+0.5e0)/{2**l}))<=1 THEN {l}"
        for l in range(base, top + 1))
    return f"""{prelude()}, {PAIRS},
lev AS (SELECT *, {ALPHA.format(lat='lat')}*dist AS adist, CASE {within} END AS lv FROM pairs),
home AS (SELECT name, box_index, lv AS home FROM (SELECT name, box_index, lv,
  row_number() OVER (PARTITION BY name, box_index ORDER BY lv) AS rn FROM lev WHERE lv IS NOT NULL) WHERE rn = {need}),
rnn AS (SELECT * FROM (SELECT l.name, l.box_index, l.index, l.value, l.adist AS dist,
  row_number() OVER (PARTITION BY l.name, l.box_index ORDER BY l.adist, l.index) AS rn
  FROM lev l JOIN home h ON h.name=l.name AND h.box_index=l.box_index AND l.lv<=h.home) WHERE rn <= {k})"""


# Delaunay triangles by brute force: every triple whose circle holds no sample. Samples on one circle
# form a fan from the lowest number, so a triple must hold it and have none of the others between its far corners.
TRIANGLES = """p AS (SELECT index, bx+0.5e0 AS x, (gy+0.5e0)*(lon_gap/lat_gap) AS y, bx, gy, value FROM means, spec),
tri0 AS (SELECT a.index AS p1, b.index AS p2, c.index AS p3, a.x AS ax, a.y AS ay, b.x-a.x AS ux, b.y-a.y AS uy, c.x-a.x AS wx, c.y-a.y AS wy,
  b.x AS bx_, b.y AS by_, c.x AS cx_, c.y AS cy_, a.value AS v1, b.value AS v2, c.value AS v3
  FROM p a JOIN p b ON a.index<b.index JOIN p c ON b.index<c.index),
tri1 AS (SELECT *, ux*wy-uy*wx AS det FROM tri0 WHERE abs(ux*wy-uy*wx) > 1e-9),
tri2 AS (SELECT *, ax+(wy*(ux*ux+uy*uy)-uy*(wx*wx+wy*wy))/(2*det) AS ox, ay+(ux*(wx*wx+wy*wy)-wx*(ux*ux+uy*uy))/(2*det) AS oy FROM tri1),
tri3 AS (SELECT *, (ox-ax)*(ox-ax)+(oy-ay)*(oy-ay) AS r2 FROM tri2),
tri4 AS (SELECT * FROM tri3 t WHERE NOT EXISTS (SELECT 1 FROM p q WHERE (q.x-t.ox)*(q.x-t.ox)+(q.y-t.oy)*(q.y-t.oy) < t.r2*(1-1e-7))),
tri AS (SELECT * FROM tri4 t WHERE NOT EXISTS (SELECT 1 FROM p q
  WHERE abs((q.x-t.ox)*(q.x-t.ox)+(q.y-t.oy)*(q.y-t.oy)-t.r2) <= t.r2*1e-7 AND q.index NOT IN (t.p1,t.p2,t.p3)
  AND (q.index < t.p1 OR ((t.cx_-t.bx_)*(q.y-t.by_)-(t.cy_-t.by_)*(q.x-t.bx_))*((t.cx_-t.bx_)*(t.ay-t.by_)-(t.cy_-t.by_)*(t.ax-t.bx_)) < 0)))"""

# Boxes in triangles (edges included), the triangle with the smallest corners on a shared edge.
BOX_POINTS = "bc AS (SELECT b.box_index, b.box_x, b.box_y, b.box_x+0.5e0 AS qx, (b.box_y+0.5e0)*(lon_gap/lat_gap) AS qy FROM boxes b, spec)"
IN_TRIANGLES = """bar AS (SELECT t.*, q.*, ((qx-ax)*wy-(qy-ay)*wx)/det AS w2, (ux*(qy-ay)-uy*(qx-ax))/det AS w3 FROM tri t, bc q),
loc AS (SELECT * FROM (SELECT *, 1-w2-w3 AS w1, row_number() OVER (PARTITION BY box_index ORDER BY p1, p2, p3) AS rn
  FROM bar WHERE w2>=-1e-9 AND w3>=-1e-9 AND 1-w2-w3>=-1e-9) WHERE rn=1)"""
LOCATED = f"{BOX_POINTS}, {IN_TRIANGLES}"

MESH = f"{prelude(SUPPLIERS)}, {TRIANGLES}"

POLYGONS = f"""{CUSTOMERS},
pb AS (SELECT region, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e,
  0.2e0 + (((round(avg(balance)) % 60e0) + 60e0) % 60e0)/100 AS f FROM c GROUP BY region),
pc AS (SELECT region, (s+n)/2 AS my, (w+e)/2 AS mx, (n-s)/2*f AS hy, (e-w)/2*f AS hx FROM pb),
edge AS (SELECT region, my-hy AS x1, mx AS y1, my AS x2, mx+hx AS y2 FROM pc
  UNION ALL SELECT region, my, mx+hx, my+hy, mx FROM pc
  UNION ALL SELECT region, my+hy, mx, my, mx-hx FROM pc
  UNION ALL SELECT region, my, mx-hx, my-hy, mx FROM pc)"""

# The polygons are convex and run one way round: a point is inside if it is on the same side of all of them.
CROSSES = "max((x2-x1)*(q.lon-y1) - (y2-y1)*(q.lat-x1)) < 0"


def raster(start_lat: str, step_lat: str, n_lat: str, start_lon: str, step_lon: str, n_lon: str) -> str:
    """CTEs up to bc: (box_index, box_lat, box_lon, qx, qy) of a raster over the test area, as expressions of spec's columns."""
    return f"""rs AS (SELECT *, CAST({n_lat} AS BIGINT) AS n_lat, CAST({n_lon} AS BIGINT) AS n_lon FROM spec),
rp AS (SELECT CAST(i*n_lon+j AS BIGINT) AS box_index, {start_lat}+i*({step_lat}) AS box_lat, {start_lon}+j*({step_lon}) AS box_lon, lat_gap, lon_gap
  FROM rs, unnest(range(n_lat)) AS u(i), unnest(range(n_lon)) AS w(j)),
bc AS (SELECT box_index, box_lat, box_lon, (box_lat-46e0)/lat_gap AS qx, (box_lon- -60e0)/lon_gap*(lon_gap/lat_gap) AS qy FROM rp)"""


def fixed_count(n_lat: int, n_lon: int) -> str:
    a, o = f"(5e0/{n_lat})", f"(7e0/{n_lon})"
    return raster(f"46e0+{a}", a, f"ceil((51e0-{a}-(46e0+{a}))/{a})", f"-60e0+{o}", o, f"ceil((-53e0-{o}-(-60e0+{o}))/{o})")


EDGE_RASTER = raster("46e0", "lat_gap", "ceil((51e0+lat_gap-46e0)/lat_gap)", "-60e0", "lon_gap", "ceil((-53e0+lon_gap- -60e0)/lon_gap)")


def degree_raster(step: float) -> str:
    n = [f"(ceil({w}e0/{step}e0)+1)" for w in (5, 7)]
    return raster("46e0", f"5e0/({n[0]}-1)", n[0], "-60e0", f"7e0/({n[1]}-1)", n[1])


# Sibson's weights: circumcentres of the conflict triangles and of the target with the rim sides are the corners of what the target
# takes from each neighbour; areas by the shoelace formula. A target on a sample has no conflict triangle and takes its value.
NATURAL = """conf AS (SELECT l.box_index, l.qx, l.qy, t.p1, t.p2, t.p3, t.ox, t.oy FROM loc l JOIN tri t ON (l.qx-t.ox)*(l.qx-t.ox)+(l.qy-t.oy)*(l.qy-t.oy) < t.r2*(1-1e-9)),
cs AS (SELECT box_index, qx, qy, p1 AS a, p2 AS b FROM conf UNION ALL SELECT box_index, qx, qy, p1, p3 FROM conf UNION ALL SELECT box_index, qx, qy, p2, p3 FROM conf),
rim0 AS (SELECT box_index, any_value(qx) AS qx, any_value(qy) AS qy, a, b FROM cs GROUP BY box_index, a, b HAVING count(*) = 1),
rim1 AS (SELECT r.*, m.x-qx AS x1, m.y-qy AS y1, n.x-qx AS x2, n.y-qy AS y2 FROM rim0 r JOIN p m ON m.index=r.a JOIN p n ON n.index=r.b),
rim AS (SELECT *, abs(x1*y2-y1*x2) < 1e-9*sqrt((x1*x1+y1*y1)*(x2*x2+y2*y2)) AS flat, CASE WHEN x1*y2-y1*x2 <> 0 THEN 2*(x1*y2-y1*x2) END AS dd FROM rim1),
pt AS (SELECT box_index, unnest([p1,p2,p3]) AS s, ox-qx AS x, oy-qy AS y, false AS flat FROM conf
  UNION ALL SELECT box_index, unnest([a,b]), (y2*(x1*x1+y1*y1)-y1*(x2*x2+y2*y2))/dd, (x1*(x2*x2+y2*y2)-x2*(x1*x1+y1*y1))/dd, flat FROM rim),
ct AS (SELECT *, x-avg(x) OVER (PARTITION BY box_index, s) AS cx, y-avg(y) OVER (PARTITION BY box_index, s) AS cy FROM pt),
ring AS (SELECT *, lead(cx) OVER o AS nx, lead(cy) OVER o AS ny, first_value(cx) OVER o AS fx, first_value(cy) OVER o AS fy FROM ct
  WINDOW o AS (PARTITION BY box_index, s ORDER BY atan2(cy, cx))),
ar AS (SELECT box_index, s, bool_or(flat) AS flat, abs(sum(cx*coalesce(ny,fy)-coalesce(nx,fx)*cy))/2 AS w FROM ring GROUP BY box_index, s),
sib AS (SELECT box_index, CASE WHEN NOT bool_or(flat) THEN sum(w*value)/sum(w) END AS value FROM ar JOIN p ON p.index=ar.s GROUP BY box_index
  UNION ALL SELECT l.box_index, p.value FROM loc l JOIN p ON p.x=l.qx AND p.y=l.qy)"""

# Slopes of least curvature of the sides by plain Jacobi steps (each at least halves the error), then the split cubic of each triangle.
SLOPES = """sd0 AS (SELECT DISTINCT i, j FROM (SELECT p1 AS i, p2 AS j FROM tri UNION ALL SELECT p2, p1 FROM tri UNION ALL SELECT p1, p3 FROM tri
  UNION ALL SELECT p3, p1 FROM tri UNION ALL SELECT p2, p3 FROM tri UNION ALL SELECT p3, p2 FROM tri)),
sd AS (SELECT i, j, b.x-a.x AS ex, b.y-a.y AS ey, b.value-a.value AS df, pow((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y), 1.5) AS cube FROM sd0 JOIN p a ON a.index=i JOIN p b ON b.index=j),
own AS (SELECT i, sum(4*ex*ex/cube) AS a, sum(4*ex*ey/cube) AS b, sum(4*ey*ey/cube) AS d, sum(6*ex*df/cube) AS rx, sum(6*ey*df/cube) AS ry FROM sd GROUP BY i),
inv AS (SELECT i, d/(a*d-b*b) AS ia, -b/(a*d-b*b) AS ib, a/(a*d-b*b) AS id, (d*rx-b*ry)/(a*d-b*b) AS bx, (a*ry-b*rx)/(a*d-b*b) AS by_ FROM own),
lk AS (SELECT sd.i, j, ex, ey, bx, by_, 2*(ia*ex+ib*ey)/cube AS lx, 2*(ib*ex+id*ey)/cube AS ly FROM sd JOIN inv ON inv.i=sd.i),
jac AS (SELECT 0 AS step, i, bx AS gx, by_ AS gy FROM inv
  UNION ALL SELECT step+1, lk.i, any_value(bx)-sum(lx*(ex*gx+ey*gy)), any_value(by_)-sum(ly*(ex*gx+ey*gy)) FROM jac JOIN lk ON lk.j=jac.i WHERE step < 60 GROUP BY step, lk.i),
slope AS (SELECT i, gx, gy FROM jac WHERE step=60)"""


def _patch() -> str:
    """CTEs up to cur: the split cubic at each located target, corner by corner."""
    xs, ys = ("ax", "bx_", "cx_"), ("ay", "by_", "cy_")
    mids = ["ms AS (" + " UNION ALL ".join(f"SELECT p{k} AS own, p{i} AS a, p{j} AS b, (ax+bx_+cx_)/3 AS mx, (ay+by_+cy_)/3 AS my FROM tri"
                                           for i, j, k in ((1, 2, 3), (1, 3, 2), (2, 3, 1))) + ")"]
    joins = " ".join(f"JOIN slope s{k} ON s{k}.i=l.p{k}" for k in (1, 2, 3))
    joins += " " + " ".join(f"LEFT JOIN ms m{k} ON m{k}.a=l.p{i} AND m{k}.b=l.p{j} AND m{k}.own<>l.p{k}" for i, j, k in ((1, 2, 3), (1, 3, 2), (2, 3, 1)))
    columns = ", ".join(f"s{k}.gx AS gx{k}, s{k}.gy AS gy{k}, m{k}.mx AS mx{k}, m{k}.my AS my{k}" for k in (1, 2, 3))
    steps = [f"q0 AS (SELECT l.*, {columns} FROM loc l {joins})"]
    edge = {(i, j): f"v{i + 1}+(gx{i + 1}*({xs[j]}-{xs[i]})+gy{i + 1}*({ys[j]}-{ys[i]}))/3" for i in range(3) for j in range(3) if i != j}
    other = [((i + 1) % 3, (i + 2) % 3) for i in range(3)]
    steps.append("q1 AS (SELECT *, " + ", ".join(f"{e} AS e{i}{j}" for (i, j), e in edge.items()) + ", " + ", ".join(
        f"((mx{i + 1}-ax)*wy-(my{i + 1}-ay)*wx)/det AS m{i}1, (ux*(my{i + 1}-ay)-uy*(mx{i + 1}-ax))/det AS m{i}2" for i in range(3)) + " FROM q0)")
    steps.append("q2 AS (SELECT *, " + ", ".join(f"(v{i + 1}+e{i}{j}+e{i}{k})/3 AS n{i}, 1-m{i}1-m{i}2 AS m{i}0" for i, (j, k) in enumerate(other)) + " FROM q1)")
    steps.append("q3 AS (SELECT *, " + ", ".join(
        f"(n{j}+n{k}+(coalesce(m{i}{j}-m{i}{i}, 0.5)*(v{j + 1}-2*e{j}{k}+e{k}{j})+coalesce(m{i}{k}-m{i}{i}, 0.5)*(v{k + 1}-2*e{k}{j}+e{j}{k}))/coalesce(3*m{i}{i}-1, -1.0))/2 AS s{i}"
        for i, (j, k) in enumerate(other)) + " FROM q2)")
    steps.append("q4 AS (SELECT *, " + ", ".join(f"(n{i}+s{j}+s{k})/3 AS c{i}" for i, (j, k) in enumerate(other)) + " FROM q3)")
    piece = ["least(w1,w2,w3)=w%d" % (i + 1) for i in range(3)]
    value = " ".join(f"WHEN {piece[i]} THEN " + "+".join(f"{c}*pow(w{j + 1}-w{i + 1},{a})*pow(w{k + 1}-w{i + 1},{b})*pow(3*w{i + 1},{d})" for c, a, b, d in (
        (f"v{j + 1}", 3, 0, 0), (f"v{k + 1}", 0, 3, 0), ("(c0+c1+c2)/3", 0, 0, 3), (f"3*e{j}{k}", 2, 1, 0), (f"3*e{k}{j}", 1, 2, 0), (f"3*n{j}", 2, 0, 1),
        (f"3*n{k}", 0, 2, 1), (f"3*c{j}", 1, 0, 2), (f"3*c{k}", 0, 1, 2), (f"6*s{i}", 1, 1, 1))) for i, (j, k) in enumerate(other))
    steps.append(f"cur AS (SELECT box_index, CASE {value} END AS value FROM q4)")
    return ", ".join([*mids, *steps])


PATCH = _patch()


def near_points(k: int) -> str:
    """CTE nn: the k nearest supplier means of each raster point."""
    return f"""pd AS (SELECT r.box_index, m.index, m.value, sqrt(pow(m.lat-r.box_lat,2)+pow(m.lon-r.box_lon,2)) AS dist FROM rp r, means m),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY box_index ORDER BY dist, index) AS rn FROM pd) WHERE rn <= {k})"""


def solved(n: int, right: int, source: str, keep: str) -> str:
    """CTEs after `source`, whose columns a<i>_<j> are a positive definite system of n rows with `right` right sides: each step takes one
    unknown out of all other rows. The last CTE, `sol`, has the solutions x<i>_<r> and the columns `keep`."""
    steps, before = [], source
    for p in range(1, n + 1):
        cells = [f"a{i}_{j} - a{i}_{p}*a{p}_{j}/a{p}_{p} AS a{i}_{j}" if i != p else f"a{i}_{j}" for i in range(1, n + 1) for j in range(p + 1, n + right + 1)]
        done = [f"a{i}_{i}" for i in range(1, p + 1)]
        steps.append(f"el{p} AS (SELECT {keep}, {', '.join(done + cells)} FROM {before})")
        before = f"el{p}"
    steps.append(f"sol AS (SELECT {keep}, " + ", ".join(f"a{i}_{n + r}/a{i}_{i} AS x{i}_{r}" for i in range(1, n + 1) for r in range(1, right + 1)) + f" FROM {before})")
    return ", ".join(steps)


def kriging(k: int) -> str:
    """CTEs after nn and fit (s, g, c, t): ordinary kriging with the linear model. With covariances M - gamma the system is positive definite
    and the sum of the weights is set by one more right side."""
    wide = ", ".join(f"max(CASE WHEN rn={i} THEN {c} END) AS {n}{i}" for i in range(1, k + 1) for c, n in (("nn.value", "v"), ("m.lat", "y"), ("m.lon", "x"), ("nn.dist", "d")))
    gamma = lambda h: f"CASE WHEN {h} > 0 THEN slope*{h}+nugget ELSE 0e0 END"
    apart = lambda i, j: f"sqrt((y{i}-y{j})*(y{i}-y{j})+(x{i}-x{j})*(x{i}-x{j}))"
    cells = [f"most - {gamma(apart(i, j))} AS a{i}_{j}" if i != j else f"most AS a{i}_{j}" for i in range(1, k + 1) for j in range(1, k + 1)]
    cells += [f"most - {gamma(f'd{i}')} AS a{i}_{k + 1}, 1e0 AS a{i}_{k + 2}" for i in range(1, k + 1)]
    keep = ", ".join(["name", "box_index", *[f"v{i}" for i in range(1, k + 1)]])
    one, two = (" + ".join(f"x{i}_{r}" for i in range(1, k + 1)) for r in (1, 2))
    value = " + ".join(f"v{i}*(x{i}_1 + x{i}_2*(1 - ({one}))/({two}))" for i in range(1, k + 1))
    return f"""model AS (SELECT name, CASE WHEN s<0 THEN 0e0 WHEN c<0 THEN t ELSE s END AS slope, CASE WHEN s<0 THEN g WHEN c<0 THEN 0e0 ELSE c END AS nugget FROM fit),
wide AS (SELECT nn.name, nn.box_index, {wide}, count(*) AS n FROM nn JOIN means m ON m.name=nn.name AND m.index=nn.index GROUP BY nn.name, nn.box_index),
k0 AS (SELECT w.*, slope, nugget, 20*(slope+nugget) AS most FROM wide w JOIN model ON model.name=w.name WHERE n={k}),
k1 AS (SELECT *, {", ".join(cells)} FROM k0),
{solved(k, 2, "k1", keep)},
kr AS (SELECT name, box_index, {value} AS value FROM sol)"""


def quadratic(k: int) -> str:
    """CTEs after nn: the polynomial of degree 2 through the k nearest by normal equations, in positions relative to the box."""
    terms = ["1", "x", "y", "x*x", "x*y", "y*y"]
    cells = ", ".join([f"sum(({terms[i]})*({terms[j]})) AS a{i + 1}_{j + 1}" for i in range(6) for j in range(6)] + [f"sum(({terms[i]})*v) AS a{i + 1}_7" for i in range(6)])
    return f"""pt AS (SELECT nn.name, nn.box_index, nn.value AS v, (m.lat-nn.box_lat)*10 AS x, (m.lon-nn.box_lon)*10 AS y FROM nn JOIN means m ON m.name=nn.name AND m.index=nn.index),
k1 AS (SELECT name, box_index, {cells} FROM pt GROUP BY name, box_index HAVING count(*)={k}),
{solved(6, 1, "k1", "name, box_index")}"""
