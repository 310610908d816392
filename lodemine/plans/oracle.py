"""DuckDB SQL for the registered queries, written independently of the Spark plans."""

from __future__ import annotations

import re

from lodemine.functions.hashing import POSITION_MUL_1, POSITION_MUL_2, POSITION_PRIME, affine_family

ORACLE: dict[str, str] = {}

REVIEWS = """reviews AS (
  SELECT o_custkey AS usr, l_suppkey AS item, (1 + floor((l_quantity - 1) / 10))::DOUBLE AS stars,
         o_orderdate AS dt, o_orderkey AS order_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CITIES = """cities AS (
  SELECT s_suppkey AS item, n_name AS city, r_name AS state, s_name AS categories
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MEANS = "means AS (SELECT city, avg(stars) AS m FROM reviews LEFT JOIN cities USING (item) GROUP BY city)"


def _top(key: str) -> str:
    return f"SELECT {key}, count(*)::BIGINT AS cnt FROM reviews GROUP BY {key} ORDER BY cnt DESC, {key} LIMIT 10"


ORACLE["review_summary"] = f"""
WITH {REVIEWS}, tu AS ({_top('usr')}), ti AS ({_top('item')})
SELECT (SELECT count(*) FROM reviews) AS n_review,
       (SELECT count(*) FROM reviews WHERE year(dt) = 1998) AS n_review_year,
       (SELECT count(DISTINCT usr) FROM reviews) AS n_user,
       (SELECT string_agg(usr || ':' || cnt, ',' ORDER BY cnt DESC, usr) FROM tu) AS top_users,
       (SELECT count(DISTINCT item) FROM reviews) AS n_item,
       (SELECT string_agg(item || ':' || cnt, ',' ORDER BY cnt DESC, item) FROM ti) AS top_items"""
ORACLE["top_users"] = f"WITH {REVIEWS} SELECT usr AS \"user\", cnt FROM ({_top('usr')})"
ORACLE["top_items"] = f"WITH {REVIEWS} {_top('item')}"
ORACLE["top_items_repartitioned"] = ORACLE["top_items"]
ORACLE["partition_totals"] = f"WITH {REVIEWS} SELECT 2::BIGINT AS n_partition, count(*)::BIGINT AS n_items FROM reviews"
ORACLE["city_avg_stars"] = f"WITH {REVIEWS}, {CITIES}, {MEANS} SELECT city, round(m, 6) AS stars FROM means"
ORACLE["top_cities"] = (
    f"WITH {REVIEWS}, {CITIES}, {MEANS} SELECT city, round(m, 6) AS stars FROM means ORDER BY m DESC NULLS LAST, city NULLS LAST LIMIT 10"
)
ORACLE["json_props_sum"] = (
    "SELECT user_id, sum(v)::BIGINT AS total FROM (SELECT user_id, unnest(map_values(CAST(props::JSON AS MAP(VARCHAR, BIGINT)))) AS v"
    " FROM events) GROUP BY user_id"
)

# --- frequent itemsets -----------------------------------------------------------------------------------------

BASKETS = """b AS (SELECT DISTINCT l_orderkey AS k, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
nb AS (SELECT count(DISTINCT k) AS n FROM b)"""
RETAIL = """raw AS (SELECT strftime(o_orderdate, '%Y-%m-%d') || '-' || o_custkey AS k, l_suppkey AS i
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT DISTINCT k, i FROM raw WHERE k IN (SELECT k FROM raw GROUP BY k HAVING count(*) > 3)),
nb AS (SELECT count(DISTINCT k) AS n FROM b)"""
CUSTOMERS = """b AS (SELECT DISTINCT l_partkey AS k, o_custkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
nb AS (SELECT count(DISTINCT k) AS n FROM b)"""
#: More levels than any of the test tables has; the level above the largest set is empty.
LEVELS = 7


def _support(share: int) -> str:
    return f"(SELECT greatest(1, n * {share} // 1000) FROM nb)"


def _levels(group: str, bound: str) -> str:
    """Level by level, the sets whose occurrences within ``group`` reach ``bound``; occurrences carry the basket."""
    parts = [f"o1 AS MATERIALIZED (SELECT {group} AS c, k, [i] AS s, i AS last FROM b)"]
    for n in range(1, LEVELS + 1):
        parts.append(f"f{n} AS MATERIALIZED (SELECT c, s, count(*)::BIGINT AS freq FROM o{n} GROUP BY c, s HAVING {bound})")
        if n < LEVELS:
            parts.append(
                f"o{n + 1} AS MATERIALIZED (SELECT o.c, o.k, list_append(o.s, b.i) AS s, b.i AS last"
                f" FROM o{n} o JOIN f{n} USING (c, s) JOIN b ON b.k = o.k AND b.i > o.last)"
            )
    rows = " UNION ALL ".join(f"SELECT {n} AS size, c, s, freq FROM f{n}" for n in range(1, LEVELS + 1))
    return ", ".join(parts) + f", sets AS (SELECT size, c, array_to_string(s, ',') AS itemset, s, freq FROM ({rows}))"


def _frequent(baskets: str, share: int) -> str:
    return f"WITH {baskets}, {_levels('0', f'count(*) >= {_support(share)}')} SELECT size, itemset, freq FROM sets"


CHUNKS = "nc AS (SELECT k % 4 AS cc, count(DISTINCT k) AS n_c FROM b GROUP BY 1)"
LOCAL = f"count(*) * (SELECT n FROM nb) >= (SELECT n_c FROM nc WHERE cc = c) * {_support(4)}"
CANDIDATES = f"{BASKETS}, {CHUNKS}, {_levels('k % 4', LOCAL)}"
ORACLE["son_candidates"] = f"WITH {CANDIDATES} SELECT DISTINCT size, itemset FROM sets"
ORACLE["son_frequent"] = _frequent(BASKETS, 4)
ORACLE["fpgrowth_frequent"] = _frequent(BASKETS, 4)
ORACLE["retail_frequent"] = _frequent(RETAIL, 3)
ORACLE["part_customers_frequent"] = _frequent(CUSTOMERS, 4)
ORACLE["apriori_triples"] = f"""
WITH {BASKETS}, p AS (SELECT x.i AS a, y.i AS c FROM b x JOIN b y ON x.k = y.k AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= {_support(22)})
SELECT 3 AS size, p.a || ',' || p.c || ',' || q.c AS itemset
FROM p JOIN p q ON p.c = q.a JOIN p r ON r.a = p.a AND r.c = q.c"""
LINE = "string_agg('(''' || replace(itemset, ',', ''', ''') || ''')', ',' ORDER BY {}) AS line"
ORACLE["itemset_report"] = f"""
WITH {CANDIDATES}, cand AS (SELECT DISTINCT size, itemset, s FROM sets),
total AS (SELECT size, itemset, s, count(*) AS freq FROM cand JOIN (SELECT k, list(i) AS items FROM b GROUP BY k) ON list_has_all(items, s) GROUP BY ALL),
every AS (SELECT 'Candidates' AS section, size, itemset, s FROM cand
          UNION ALL SELECT 'Frequent Itemsets', size, itemset, s FROM total WHERE freq >= {_support(4)})
SELECT section, size, 0 AS segment, {LINE.format("s")} FROM every GROUP BY section, size"""
BY_TEXT = LINE.format("'(''' || replace(itemset, ',', ''', ''') || ''')'")
ORACLE["retail_report"] = f"SELECT 'Frequent Itemsets' AS section, size, 0 AS segment, {BY_TEXT} FROM ({ORACLE['retail_frequent']}) GROUP BY size"

# --- similarity ------------------------------------------------------------------------------------------------

WORDS = r"""w AS (SELECT DISTINCT doc_id, word FROM
  (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \t\n\r\f]+')) AS word FROM documents) WHERE word <> '')"""
GROUPS = """sig AS (SELECT doc_id, string_agg(word, ' ' ORDER BY word) AS s, count(*) AS size FROM w GROUP BY doc_id),
groups AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep, count(*) OVER (PARTITION BY s) AS n_copies, size FROM sig),
reps AS (SELECT * FROM groups WHERE doc_id = rep),
rw AS (SELECT w.doc_id, word FROM w JOIN reps USING (doc_id))"""
EXACT = """common AS (SELECT x.doc_id AS a, y.doc_id AS c, count(*) AS n FROM rw x JOIN rw y ON x.word = y.word AND x.doc_id < y.doc_id GROUP BY 1, 2),
exact AS (SELECT a, c, p.n_copies AS n1, q.n_copies AS n2, n / (p.size + q.size - n) AS s
          FROM common JOIN reps p ON a = p.doc_id JOIN reps q ON c = q.doc_id)"""


def _family(n: int, seed: int, *bounds: int) -> str:
    rows = ",".join(f"({j},{a}::BIGINT,{b}::BIGINT)" for j, a, b in affine_family(n, seed, *bounds))
    return f"fam AS (SELECT * FROM (VALUES {rows}) t(j, a, b))"


LSH_FAMILY = _family(80, 80, 10001, 10000)
LSH_PRIME = 2147483647
WIDE_FAMILY = _family(80, 80, LSH_PRIME + 1, LSH_PRIME)
INDEX = "idx AS (SELECT word, ('0x' || left(md5(word), 8))::BIGINT % 2147483647 AS i FROM (SELECT DISTINCT word FROM w))"
RANKS = "idx AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM (SELECT DISTINCT word FROM w))"
ORACLE["minhash_signature"] = f"""
WITH {WORDS}, {RANKS}, {LSH_FAMILY}
SELECT doc_id, j AS hash_no, min((a * i + b) % 10000)::BIGINT AS min_hash FROM w JOIN idx USING (word), fam GROUP BY 1, 2"""
ORACLE["jaccard_copies"] = f"WITH {WORDS}, {GROUPS} SELECT doc_id, rep, n_copies FROM groups"
ORACLE["jaccard_pairs"] = f"""
WITH {WORDS}, {GROUPS}, {EXACT}
SELECT a AS item_1, c AS item_2, n1 AS n_copies_1, n2 AS n_copies_2, round(s, 6) AS similarity FROM exact WHERE s >= 0.5"""
ORACLE["lsh_pairs"] = f"""
WITH {WORDS}, {GROUPS}, {EXACT}, {INDEX}, {WIDE_FAMILY},
mh AS (SELECT doc_id, j, min((a * i + b) % {LSH_PRIME}) AS m FROM rw JOIN idx USING (word), fam GROUP BY 1, 2),
bands AS (SELECT doc_id, j // 4 AS band, string_agg(m, ',' ORDER BY j) AS bucket FROM mh GROUP BY 1, 2),
near AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS c FROM bands x JOIN bands y USING (band, bucket) WHERE x.doc_id < y.doc_id)
SELECT a AS item_1, c AS item_2, n1 AS n_copies_1, n2 AS n_copies_2, round(s, 6) AS similarity
FROM exact JOIN near USING (a, c) WHERE s >= 0.5"""

# --- recommendation --------------------------------------------------------------------------------------------

TRAIN_TEST = f"""{REVIEWS},
train AS (SELECT usr, item, avg(stars) AS r FROM reviews WHERE order_key % 5 <> 0 GROUP BY 1, 2),
test AS (SELECT usr, item, avg(stars) AS r FROM reviews WHERE order_key % 5 = 0 GROUP BY 1, 2)"""
SIMS = """pop AS (SELECT item FROM train GROUP BY item HAVING count(*) >= 30),
pt AS (SELECT * FROM train WHERE item IN (SELECT item FROM pop)),
sims AS (
  SELECT x.item AS item_1, y.item AS item_2, count(*)::BIGINT AS n,
         CASE WHEN min(x.r) = max(x.r) OR min(y.r) = max(y.r) THEN 0.0 ELSE corr(x.r, y.r) END AS weight
  FROM pt x JOIN pt y ON x.usr = y.usr AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 30)"""
CF = """nb AS (SELECT item_1 AS item, item_2 AS nbr, weight FROM sims WHERE weight > 0
       UNION ALL SELECT item_2, item_1, weight FROM sims WHERE weight > 0),
parts AS (SELECT t.usr, t.item, sum(tr.r * weight) / sum(abs(weight)) AS cf, count(*) AS nn
          FROM test t JOIN nb ON t.item = nb.item JOIN train tr ON tr.usr = t.usr AND tr.item = nbr GROUP BY 1, 2),
im AS (SELECT item, avg(r) AS m FROM train GROUP BY item),
pred AS (SELECT t.usr, t.item, t.r, coalesce(cf, m, 3.0) AS p, coalesce(nn, 0) AS nn, cf, coalesce(m, 3.0) AS mb
         FROM test t LEFT JOIN parts USING (usr, item) LEFT JOIN im USING (item))"""
ORACLE["item_pearson"] = f"WITH {TRAIN_TEST}, {SIMS} SELECT item_1, item_2, n, round(weight, 6) AS weight FROM sims"
ORACLE["cf_predict"] = f"""
WITH {TRAIN_TEST}, {SIMS}, {CF}
SELECT usr AS "user", item, round(p, 6) AS prediction, nn::BIGINT AS n_neighbours FROM pred"""
ORACLE["cf_rmse"] = f"""
WITH {TRAIN_TEST}, {SIMS}, {CF} SELECT round(sqrt(avg((p - r) * (p - r))), 6) AS rmse, count(*)::BIGINT AS n FROM pred"""
PROFILES = f"""{CITIES},
users AS (SELECT usr, count(*)::BIGINT AS uc, avg(stars) AS us FROM reviews WHERE order_key % 5 <> 0 GROUP BY usr),
items AS (SELECT item, count(*)::BIGINT AS ic, avg(stars) AS ist FROM reviews WHERE order_key % 5 <> 0 GROUP BY item)"""
BASIC = """basic AS (
  SELECT t.usr, t.item, t.r, coalesce(uc, 0) AS uc, coalesce(us, (SELECT avg(us) FROM users)) AS us,
         coalesce(ic, 0) AS ic, coalesce(ist, (SELECT avg(ist) FROM items)) AS ist
  FROM test t LEFT JOIN users USING (usr) LEFT JOIN items USING (item))"""
BASIC_COLUMNS = """usr AS "user", item, round(r, 6) AS rating, uc AS user_review_cnt, round(us, 6) AS user_stars,
       ic AS item_review_cnt, round(ist, 6) AS item_stars"""
ORACLE["features_basic"] = f"WITH {TRAIN_TEST}, {PROFILES}, {BASIC} SELECT {BASIC_COLUMNS} FROM basic"
ORACLE["features_wide"] = f"""
WITH {TRAIN_TEST}, {PROFILES}, {BASIC},
ev AS (SELECT user_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events),
ut AS (SELECT user_id AS usr, count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY 1),
it AS (SELECT k AS item, count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY 1),
ph AS (SELECT k AS item, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY 1),
ch AS (SELECT user_id AS item, sum(k)::BIGINT AS n FROM ev GROUP BY 1)
SELECT {BASIC_COLUMNS}, coalesce(floor(c_acctbal), 0)::BIGINT AS useful, coalesce(ut.n, 0)::BIGINT AS user_tip_cnt,
       coalesce(contains(categories, '7'), false)::INT AS is_restaurant, coalesce(ph.n, 0)::BIGINT AS photo_cnt,
       coalesce(it.n, 0)::BIGINT AS tip_cnt, coalesce(ch.n, 0)::BIGINT AS checkin_cnt,
       coalesce(state = 'AMERICA', false)::INT AS state_america, coalesce(state = 'ASIA', false)::INT AS state_asia,
       coalesce(state = 'EUROPE', false)::INT AS state_europe, coalesce(state = 'MIDDLE EAST', false)::INT AS state_middle_east
FROM basic LEFT JOIN customer ON usr = c_custkey LEFT JOIN cities USING (item) LEFT JOIN ut USING (usr) LEFT JOIN it USING (item)
     LEFT JOIN ph USING (item) LEFT JOIN ch USING (item)"""
ORACLE["hybrid_blend"] = f"""
WITH {TRAIN_TEST}, {SIMS}, {CF}, {PROFILES},
x AS (SELECT usr, item, cf, mb, CASE WHEN nn > 0 THEN nn * 60.0::DOUBLE / (nn * 60.0::DOUBLE + coalesce(uc, 0) + coalesce(ic, 0)) ELSE 0.0 END AS alpha
      FROM pred LEFT JOIN users USING (usr) LEFT JOIN items USING (item))
SELECT usr AS "user", item, round(alpha::DOUBLE, 6) AS alpha, round(alpha * coalesce(cf, 0.0) + (1 - alpha) * mb, 6) AS prediction FROM x"""

# Boosted trees replayed: the features of all pairs, binned; then, level by level, the best cut of each node by histogram sums.
# Three quarters of the stars follow from the price here.
PRICED = TRAIN_TEST.replace("(1 + floor((l_quantity - 1) / 10))::DOUBLE", "((1 + floor((l_quantity - 1) / 10)) + 3 * (5 - least(floor(l_extendedprice / 20000), 4)))::DOUBLE / 4")
PAIRS = f"""{PRICED},
spent AS (SELECT o_custkey AS usr, l_suppkey AS item, l_orderkey % 5 = 0 AS is_test, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) AS spend
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
pairs AS (SELECT usr, item, r, is_test, spend FROM (SELECT *, false AS is_test FROM train UNION ALL SELECT *, true FROM test) JOIN spent USING (usr, item, is_test)),
{PROFILES},
ev AS (SELECT user_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events),
ut AS (SELECT user_id AS usr, count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY 1),
it AS (SELECT k AS item, count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY 1),
ph AS (SELECT k AS item, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY 1),
ch AS (SELECT user_id AS item, sum(k)::BIGINT AS n FROM ev GROUP BY 1),
told AS (SELECT p.*, coalesce(uc, 0) AS uc, coalesce(us, (SELECT avg(us) FROM users)) AS us, coalesce(ic, 0) AS ic, coalesce(ist, (SELECT avg(ist) FROM items)) AS ist,
         coalesce(floor(c_acctbal), 0) AS useful, coalesce(ut.n, 0) AS utc, coalesce(contains(categories, '7'), false)::INT AS isr, coalesce(ph.n, 0) AS phc,
         coalesce(it.n, 0) AS tc, coalesce(ch.n, 0) AS cc, coalesce(state, '') AS state
  FROM pairs p LEFT JOIN users USING (usr) LEFT JOIN items USING (item) LEFT JOIN customer ON usr = c_custkey LEFT JOIN cities USING (item)
       LEFT JOIN ut USING (usr) LEFT JOIN it USING (item) LEFT JOIN ph USING (item) LEFT JOIN ch USING (item))"""
# Features in order of their names.
BASIC_INPUTS = ["ic", "ist", "spend", "uc", "us"]
WIDE_INPUTS = ["cc", "isr", "ic", "ist", "phc", "spend", *[f"(state = '{s}')::INT" for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")], "tc", "useful", "uc", "us", "utc"]


def _boosted(inputs: list[str], rounds: int = 3, depth: int = 3, bins: int = 16, rate: float = 0.5) -> str:
    """boosted(usr, item, r, is_test, p)."""
    shares = ", ".join(str(k / bins) for k in range(1, bins))
    parts = [f"""rows0 AS MATERIALIZED (SELECT usr, item, r, is_test, [{', '.join(f'({x})::DOUBLE' for x in inputs)}] AS x FROM told),
cuts AS MATERIALIZED (SELECT f, list_distinct(quantile_disc(v, [{shares}])) AS c FROM (SELECT unnest(range(1, {len(inputs) + 1})) AS f, unnest(x) AS v FROM rows0 WHERE NOT is_test) GROUP BY f),
allcuts AS (SELECT list(c ORDER BY f) AS c FROM cuts),
s0 AS MATERIALIZED (SELECT usr, item, r, is_test, list_transform(range(1, {len(inputs) + 1}), lambda f: len(list_filter(allcuts.c[f], lambda y: y < x[f]))) AS b,
  (SELECT sum(floor(r * 1048576 + 0.5)::BIGINT)::DOUBLE / count(*) / 1048576 FROM rows0 WHERE NOT is_test) AS p FROM rows0, allcuts)"""]
    for t in range(1, rounds + 1):
        parts.append(f"t{t}_0 AS MATERIALIZED (SELECT *, floor((p - r) * 1048576 + 0.5)::BIGINT AS g, 1 AS node FROM s{t - 1})")
        for d in range(1, depth + 1):
            parts.append(f"""h{t}_{d} AS (SELECT node, f, bin, sum(g)::DOUBLE AS g, count(*)::DOUBLE AS h
  FROM (SELECT node, g, unnest(range(1, {len(inputs) + 1})) AS f, unnest(b) AS bin FROM t{t}_{d - 1} WHERE NOT is_test) GROUP BY 1, 2, 3),
c{t}_{d} AS (SELECT node, f, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER n AS ga, sum(h) OVER n AS ha FROM h{t}_{d}
  WINDOW w AS (PARTITION BY node, f ORDER BY bin ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY node, f)),
k{t}_{d} AS MATERIALIZED (SELECT node, f, bin FROM (SELECT *, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) AS gain FROM c{t}_{d} WHERE hl < ha)
  WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1),
t{t}_{d} AS MATERIALIZED (SELECT s.* EXCLUDE node, CASE WHEN k.f IS NULL THEN s.node WHEN s.b[k.f] > k.bin THEN 2 * s.node + 1 ELSE 2 * s.node END AS node
  FROM t{t}_{d - 1} s LEFT JOIN k{t}_{d} k USING (node))""")
        parts.append(f"""s{t} AS MATERIALIZED (SELECT usr, item, r, is_test, b, p + v AS p FROM t{t}_{depth}
  JOIN (SELECT node, -sum(g)::DOUBLE / (count(*) + 1) * {rate} / 1048576 AS v FROM t{t}_{depth} WHERE NOT is_test GROUP BY node) USING (node))""")
    return ",\n".join(parts) + f", boosted AS (SELECT usr, item, r, is_test, p FROM s{rounds})"


def _check(predictions: str) -> str:
    return f"""SELECT count(*) AS n, round(min(p), 6) AS lowest, round(max(p), 6) AS highest, round(avg((p - r) * (p - r)), 6) AS squared_error,
       avg((p - r) * (p - r)) <= 0.5 * avg((r - m) * (r - m)) AS half_of_mean_or_less FROM {predictions}, (SELECT avg(r) AS m FROM train)"""


WIDE = f"WITH {PAIRS}, {_boosted(WIDE_INPUTS)}"
ORACLE["gbt_predict"] = f'{WIDE} SELECT usr AS "user", item, round(p, 6) AS prediction FROM boosted WHERE is_test'
ORACLE["gbt_rmse"] = f"{WIDE} SELECT round(sqrt(avg((p - r) * (p - r))), 6) AS rmse, count(*) AS n FROM boosted WHERE is_test"
ORACLE["gbt_wide_checked"] = f"{WIDE} {_check('(SELECT * FROM boosted WHERE is_test)')}"
ORACLE["gbt_basic_checked"] = f"WITH {PAIRS}, {_boosted(BASIC_INPUTS)} {_check('(SELECT * FROM boosted WHERE is_test)')}"
HYBRID = f"""{WIDE}, {SIMS}, {CF},
x AS (SELECT usr, item, b.r, cf, b.p AS mb, CASE WHEN nn > 0 THEN nn * 60.0::DOUBLE / (nn * 60.0::DOUBLE + coalesce(uc, 0) + coalesce(ic, 0)) ELSE 0.0 END::DOUBLE AS alpha
      FROM pred JOIN (SELECT * FROM boosted WHERE is_test) b USING (usr, item) LEFT JOIN users USING (usr) LEFT JOIN items USING (item)),
hybrid AS (SELECT usr, item, r, alpha, alpha * coalesce(cf, 0.0) + (1 - alpha) * mb AS p FROM x)"""
ORACLE["hybrid_predict"] = f'{HYBRID} SELECT usr AS "user", item, round(alpha, 6) AS alpha, round(p, 6) AS prediction FROM hybrid'
ORACLE["hybrid_checked"] = f"{HYBRID} {_check('hybrid')}"

# --- graph -----------------------------------------------------------------------------------------------------

EDGES = """act AS (SELECT DISTINCT user_id AS u, event_type || '|' || strftime(ts, '%Y-%m-%d %H') AS i FROM events),
edges AS MATERIALIZED (SELECT x.u AS src, y.u AS dst, count(*)::BIGINT AS shared FROM act x JOIN act y ON x.i = y.i AND x.u < y.u
          GROUP BY 1, 2 HAVING count(*) >= 6),
both_ways AS MATERIALIZED (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
vertices AS MATERIALIZED (SELECT DISTINCT src AS id FROM both_ways)"""
ORACLE["graph_edges"] = f"WITH {EDGES} SELECT src, dst, shared FROM edges"
ORACLE["graph_degree"] = f"WITH {EDGES} SELECT src AS id, count(DISTINCT dst)::BIGINT AS degree FROM both_ways GROUP BY src"


def _label_rounds(n: int) -> str:
    parts = ["l0 AS MATERIALIZED (SELECT id, id AS c FROM vertices)"]
    for k in range(1, n + 1):
        parts.append(
            f"l{k} AS MATERIALIZED (SELECT dst AS id, c FROM (SELECT dst, c, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, c) AS rk"
            f" FROM both_ways JOIN l{k - 1} ON src = id GROUP BY dst, c) WHERE rk = 1)"
        )
    return ", ".join(parts)


ORACLE["label_propagation"] = f"WITH {EDGES}, {_label_rounds(5)} SELECT id, c AS community FROM l5"
ORACLE["community_lines"] = f"""
WITH {EDGES}, {_label_rounds(5)}
SELECT count(*)::BIGINT AS size, c AS community, 0 AS segment, string_agg(id, ', ' ORDER BY id) AS line FROM l5 GROUP BY c"""
ORACLE["connected_components"] = f"""
WITH RECURSIVE {EDGES}, reach(id, r) AS (SELECT id, id FROM vertices UNION SELECT dst, r FROM reach JOIN both_ways ON src = id)
SELECT id, min(r) AS component FROM reach GROUP BY id"""
BETWEENNESS = """walk(s, v, d) AS (SELECT id, id, 0 FROM vertices UNION SELECT s, dst, d + 1 FROM walk JOIN both_ways ON src = v WHERE d < 20),
dist AS MATERIALIZED (SELECT s, v, min(d) AS d FROM walk GROUP BY s, v),
path(s, v, d, step) AS (SELECT id, id, 0, 0 FROM vertices UNION ALL
  SELECT p.s, e.dst, p.d + 1, 0 FROM path p JOIN both_ways e ON e.src = p.v JOIN dist x ON x.s = p.s AND x.v = e.dst AND x.d = p.d + 1),
sigma AS MATERIALIZED (SELECT s, v, d, count(*) AS n FROM path GROUP BY s, v, d),
scores AS (SELECT e.src, e.dst, sum(a.n * z.n / st.n) AS betweenness
  FROM edges e JOIN sigma a ON a.v IN (e.src, e.dst)
       JOIN sigma z ON z.s = CASE WHEN a.v = e.src THEN e.dst ELSE e.src END
       JOIN sigma st ON st.s = a.s AND st.v = z.v AND st.d = a.d + 1 + z.d
  WHERE a.s < z.v GROUP BY 1, 2)"""
ORACLE["edge_betweenness"] = f"WITH RECURSIVE {EDGES}, {BETWEENNESS} SELECT src, dst, round(betweenness, 6) AS betweenness FROM scores"
ORACLE["betweenness_report"] = f"""
WITH RECURSIVE {EDGES}, {BETWEENNESS}
SELECT '(''' || src || ''', ''' || dst || '''),' || round(betweenness, 5) AS line FROM scores"""
ORACLE["girvan_newman_round"] = f"""
WITH RECURSIVE {EDGES}, {BETWEENNESS},
top AS (SELECT max(betweenness) * (1 - 1e-9) AS t FROM scores),
rest AS MATERIALIZED (SELECT src, dst FROM scores, top WHERE betweenness < t UNION ALL SELECT dst, src FROM scores, top WHERE betweenness < t),
reach(id, r) AS (SELECT id, id FROM vertices UNION SELECT dst, r FROM reach JOIN rest ON src = id),
part AS MATERIALIZED (SELECT id, min(r) AS c FROM reach GROUP BY id),
k AS (SELECT src AS id, count(*) AS k FROM both_ways GROUP BY 1), m AS (SELECT count(*)::DOUBLE AS m FROM edges),
inner_ends AS (SELECT count(*) AS n FROM both_ways JOIN part p ON p.id = src JOIN part q ON q.id = dst WHERE p.c = q.c),
degrees AS (SELECT sum(d * d) AS dd FROM (SELECT sum(k) AS d FROM k JOIN part USING (id) GROUP BY c))
SELECT 1 AS round, (SELECT count(*) FROM scores, top WHERE betweenness >= t) AS n_cut, (SELECT count(DISTINCT c) FROM part) AS n_communities,
       round(n / (2 * m) - dd / (4 * m * m), 6) AS modularity FROM m, inner_ends, degrees"""


def _divisive(rounds: int) -> str:
    """part_{r}(id, c) and q_{r}(q) after each round of cutting all edges of the highest betweenness; left_{r}(src, dst) are the edges left."""
    parts = [EDGES, "left_0 AS (SELECT src, dst FROM edges)", "k AS (SELECT src AS id, count(*) AS k FROM both_ways GROUP BY 1)", "m AS (SELECT count(*)::DOUBLE AS m FROM edges)"]
    for r in range(1, rounds + 1):
        named = re.sub(r"\b(walk|both_ways|vertices|edges|dist|path|sigma|scores)\b", rf"\1_{r}", BETWEENNESS)
        parts.append(f"""edges_{r} AS MATERIALIZED (SELECT src, dst FROM left_{r - 1}),
both_ways_{r} AS MATERIALIZED (SELECT src, dst FROM edges_{r} UNION ALL SELECT dst, src FROM edges_{r}),
vertices_{r} AS MATERIALIZED (SELECT DISTINCT src AS id FROM both_ways_{r}), {named},
left_{r} AS MATERIALIZED (SELECT src, dst FROM scores_{r} WHERE betweenness < (SELECT max(betweenness) FROM scores_{r}) * (1 - 1e-9)),
reach_{r}(id, r) AS (SELECT id, id FROM vertices UNION SELECT e.dst, r FROM reach_{r} t JOIN (SELECT src, dst FROM left_{r} UNION ALL SELECT dst, src FROM left_{r}) e ON e.src = t.id),
part_{r} AS MATERIALIZED (SELECT id, min(r) AS c FROM reach_{r} GROUP BY id),
q_{r} AS (SELECT (SELECT count(*) FROM both_ways JOIN part_{r} p ON p.id = src JOIN part_{r} q ON q.id = dst WHERE p.c = q.c) / (2 * m)
  - (SELECT sum(d * d) FROM (SELECT sum(k) AS d FROM k JOIN part_{r} USING (id) GROUP BY c)) / (4 * m * m) AS q FROM m WHERE EXISTS (SELECT 1 FROM edges_{r}))""")
    return "WITH RECURSIVE " + ",\n".join(parts)


_ROUNDS = 24
_QS = " UNION ALL ".join(f"SELECT {r} AS r, q FROM q_{r}" for r in range(1, _ROUNDS + 1))
_PARTS = " UNION ALL ".join(f"SELECT {r} AS r, id, c FROM part_{r}" for r in range(1, _ROUNDS + 1))
ORACLE["girvan_newman"] = f"""{_divisive(_ROUNDS)}, best AS (SELECT r FROM ({_QS}) ORDER BY round(q, 12) DESC, r LIMIT 1),
found AS (SELECT id, c FROM ({_PARTS}) JOIN best USING (r))
SELECT count(*) OVER (PARTITION BY c) AS size, c AS community, id FROM found"""
ORACLE["modularity"] = f"""
WITH {EDGES}, k AS (SELECT src AS id, count(*) AS k FROM both_ways GROUP BY 1), m AS (SELECT count(*) AS m FROM edges)
SELECT round((SELECT sum(CASE WHEN e.src IS NULL THEN 0 ELSE 1 END - a.k * c.k / (2 * m)) FROM k a JOIN k c ON a.id % 3 = c.id % 3
              LEFT JOIN both_ways e ON e.src = a.id AND e.dst = c.id) / (2 * m), 6) AS modularity FROM m"""

# --- chunked clustering ----------------------------------------------------------------------------------------

POINTS = "p AS (SELECT vec_id AS id, label AS c, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
STATS = """st AS (SELECT c, dim, count(*)::BIGINT AS n, sum(x) AS s, sum(x * x) AS ss FROM p GROUP BY 1, 2)"""
ORACLE["bfr_cluster_stats"] = f"""
WITH {POINTS}, {STATS} SELECT c::BIGINT AS cluster, n, dim::INT AS dim, round(s, 6) AS sum, round(ss, 6) AS sumsq FROM st"""
ORACLE["bfr_merge_stats"] = ORACLE["bfr_cluster_stats"]
ORACLE["bfr_assign"] = f"""
WITH {POINTS}, {STATS}, d AS (
  SELECT id, st.c AS c, sqrt(sum(((x - s / n) * (x - s / n)) / (ss / n - (s / n) * (s / n)))) AS d
  FROM p JOIN st USING (dim) GROUP BY 1, 2),
best AS (SELECT id, c, d, row_number() OVER (PARTITION BY id ORDER BY d, c) AS rk FROM d)
SELECT id, CASE WHEN d < sqrt(64) THEN c ELSE -1 END::BIGINT AS cluster, round(d, 6) AS distance FROM best WHERE rk = 1"""
ORACLE["bfr_cluster_dist"] = f"""
WITH {POINTS}, {STATS}
SELECT x.c::BIGINT AS a, y.c::BIGINT AS b,
       round(sqrt(sum(power(x.s / x.n - y.s / y.n, 2) / ((x.ss + y.ss) / (x.n + y.n) - power((x.s + y.s) / (x.n + y.n), 2)))), 6) AS distance
FROM st x JOIN st y ON x.dim = y.dim AND x.c < y.c GROUP BY 1, 2"""



def _centres(name: str, points: str, k: int, steps: int) -> str:
    """{name}(id, x, c): the points by nearest centre after Lloyd steps; {name}_n has the sizes.

    First centres: of the 4 k points of least hash the first, then each time the one farthest from those taken.
    """
    return f"""
{name}_s(c, rk, x, apart) AS (
  SELECT 0, rk, x, 'inf'::DOUBLE FROM (SELECT x, row_number() OVER (ORDER BY md5('0:' || id), id) AS rk FROM {points}) WHERE rk <= {4 * k}
  UNION ALL
  SELECT s.c + 1, s.rk, s.x, least(s.apart, list_distance(s.x, t.x))
  FROM {name}_s s JOIN (SELECT arg_max(x, {{'d': apart, 'rk': -rk}}) AS x FROM {name}_s) t ON true WHERE s.c + 1 < {k}),
{name}_l(step, c, m) AS (
  SELECT 0, c, arg_max(x, {{'d': apart, 'rk': -rk}}) FROM {name}_s GROUP BY c HAVING max(apart) > 0
  UNION ALL
  SELECT step, c, list(v ORDER BY dim) FROM (
    SELECT step, c, dim, avg(v) AS v FROM (
      SELECT step, c, unnest(range(1, 65)) AS dim, unnest(x) AS v FROM (
        SELECT l.step + 1 AS step, t.id, any_value(t.x) AS x, arg_min(l.c, {{'d': list_distance(t.x, l.m), 'c': l.c}}) AS c
        FROM {points} t, {name}_l l WHERE l.step < {steps} GROUP BY 1, 2))
    GROUP BY 1, 2, 3) GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT t.id, any_value(t.x) AS x, arg_min(l.c, {{'d': list_distance(t.x, l.m), 'c': l.c}}) AS c
  FROM {points} t, {name}_l l WHERE l.step = {steps} GROUP BY t.id),
{name}_n AS MATERIALIZED (SELECT c, count(*) AS n FROM {name} GROUP BY c)"""


def _sums(members: str) -> str:
    """(c, n, s, ss) of the clusters of points (id, x, c)."""
    return f"""(SELECT c, any_value(n) AS n, list(s ORDER BY dim) AS s, list(ss ORDER BY dim) AS ss FROM (
      SELECT c, dim, count(*) AS n, sum(v) AS s, sum(v * v) AS ss FROM (SELECT c, unnest(range(1, 65)) AS dim, unnest(x) AS v FROM {members}) GROUP BY c, dim) GROUP BY c)"""


def _near(points: str, sums: str, limit: float) -> str:
    """(id, x, c): the nearest cluster within the limit, distances in its own standard deviations, else -1."""
    var = "q.ss[i] / q.n - (q.s[i] / q.n) ** 2"
    d = f"sqrt(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN {var} > 0 THEN (t.x[i] - q.s[i] / q.n) ** 2 / ({var}) ELSE 'inf'::DOUBLE END)))"
    return f"""(SELECT id, x, CASE WHEN best.d < {limit} THEN best.c ELSE -1 END AS c FROM (
      SELECT t.id, any_value(t.x) AS x, min({{'d': coalesce({d}, 'inf'::DOUBLE), 'c': coalesce(q.c, -1)}}) AS best FROM {points} t LEFT JOIN {sums} q ON true GROUP BY t.id))"""


def _gap(limit: float) -> str:
    """Whether the clusters a and b are nearer than the limit, in standard deviations of both together."""
    n, s, ss = "(a.n + b.n)", "(a.s[i] + b.s[i])", "(a.ss[i] + b.ss[i])"
    var = f"{ss} / {n} - ({s} / {n}) ** 2"
    return f"sqrt(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN {var} > 0 THEN (a.s[i] / a.n - b.s[i] / b.n) ** 2 / ({var}) ELSE 'inf'::DOUBLE END))) < {limit}"


def _merged(name: str, sums: str, limit: float, into: bool = False) -> str:
    """{name}(kind, c, n, s, ss, born): close clusters added up, the first close pair in order of keys first.

    With ``into``, kind 0 takes from kind 1; else all are of kind 1. ``born`` lists the keys that a cluster was made of.
    """
    pair = "a.kind = 0 AND b.kind = 1" if into else "a.c < b.c"
    both = "list_transform(range(1, 65), lambda i: t.{0}[i] + u.{0}[i])"
    return f"""
{name}_m(it, kind, c, n, s, ss, born) AS (
  SELECT 0, kind, c, n, s, ss, [c] FROM {sums}
  UNION ALL
  SELECT t.it + 1, t.kind, t.c, CASE WHEN u.c IS NULL THEN t.n ELSE t.n + u.n END, CASE WHEN u.c IS NULL THEN t.s ELSE {both.format("s")} END,
         CASE WHEN u.c IS NULL THEN t.ss ELSE {both.format("ss")} END, CASE WHEN u.c IS NULL THEN t.born ELSE list_concat(t.born, u.born) END
  FROM {name}_m t
  JOIN (SELECT a.kind AS ak, a.c AS ac, b.kind AS bk, b.c AS bc FROM {name}_m a JOIN {name}_m b ON {pair} WHERE {_gap(limit)} ORDER BY a.c, b.c LIMIT 1) p ON true
  LEFT JOIN {name}_m u ON t.kind = p.ak AND t.c = p.ac AND u.kind = p.bk AND u.c = p.bc
  WHERE NOT (t.kind = p.bk AND t.c = p.bc)),
{name} AS MATERIALIZED (SELECT * EXCLUDE it FROM {name}_m WHERE it = (SELECT max(it) FROM {name}_m))"""


def _chunked_clustering(k: int, first: int, rest: int, radius: float, steps: int, chunks: int = 5) -> str:
    """d{r}, q{r}, r{r}: the discard members (id, x, c), compression sums and members (qm), and retained points after each round."""
    limit = radius * 8
    parts = [f"""
p AS MATERIALIZED (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS x, ((row_number() OVER (ORDER BY md5('0:' || vec_id), vec_id) - 1) * {chunks}) // count(*) OVER () AS chunk FROM embeddings),
t0 AS MATERIALIZED (SELECT id, x FROM p WHERE chunk = 0)""", _centres("f", "t0", first, steps), """
several AS MATERIALIZED (SELECT id, x FROM f WHERE c IN (SELECT c FROM f_n WHERE n > 1) OR NOT EXISTS (SELECT 1 FROM f_n WHERE n > 1)),
left1 AS MATERIALIZED (SELECT id, x FROM t0 WHERE id NOT IN (SELECT id FROM several))""", _centres("d1", "several", k, steps)]
    for r in range(1, chunks + 1):
        if r > 1:
            parts.append(f"""
t{r} AS MATERIALIZED (SELECT id, x FROM p WHERE chunk = {r - 1}),
nd{r} AS MATERIALIZED {_near(f"t{r}", f"ds{r - 1}", limit)},
td{r} AS MATERIALIZED (SELECT id, x FROM nd{r} WHERE c = -1),
nc{r} AS MATERIALIZED {_near(f"td{r}", f"q{r - 1}", limit)},
d{r} AS MATERIALIZED (SELECT id, x, c FROM d{r - 1} UNION ALL SELECT id, x, c FROM nd{r} WHERE c <> -1),
left{r} AS MATERIALIZED (SELECT id, x FROM r{r - 1} UNION ALL SELECT id, x FROM nc{r} WHERE c = -1)""")
        parts.append(_centres(f"g{r}", f"left{r}", rest, steps))
        before = "" if r == 1 else f"SELECT id, x, c FROM qm{r - 1} UNION ALL SELECT id, x, c FROM nc{r} WHERE c <> -1 UNION ALL "
        shift = "0" if r == 1 else f"(SELECT coalesce(max(c) + 1, 0) FROM ({' UNION ALL '.join(f'SELECT c FROM b{i}' for i in range(1, r))}))"
        parts.append(f"""
b{r} AS MATERIALIZED (SELECT id, x, c + {shift} AS c FROM g{r} WHERE c IN (SELECT c FROM g{r}_n WHERE n > 1)),
r{r} AS MATERIALIZED (SELECT id, x FROM g{r} WHERE c IN (SELECT c FROM g{r}_n WHERE n = 1)),
all{r} AS MATERIALIZED ({before}SELECT id, x, c FROM b{r}),
ds{r} AS MATERIALIZED {_sums(f"d{r}")},
as{r} AS MATERIALIZED {_sums(f"all{r}")}""")
        # The first round makes clusters, and merges none.
        parts.append(f"\nq{r} AS MATERIALIZED (SELECT 1 AS kind, c, n, s, ss, [c] AS born FROM as{r})" if r == 1 else _merged(f"q{r}", f"(SELECT 1 AS kind, * FROM as{r})", limit))
        parts.append(f"\nqm{r} AS MATERIALIZED (SELECT a.id, a.x, q.c FROM all{r} a JOIN (SELECT c, unnest(born) AS b FROM q{r}) q ON q.b = a.c)")
    last = chunks
    parts.append(_merged("fin", f"(SELECT 0 AS kind, c, n, s, ss FROM ds{last} UNION ALL SELECT 1, c, n, s, ss FROM q{last})", limit, into=True))
    return "WITH RECURSIVE" + ",".join(x for x in parts)


CLUSTERED = _chunked_clustering(k=10, first=30, rest=30, radius=1.1, steps=6)
_COUNTS = " UNION ALL ".join(
    f"SELECT {r}::INT AS round, (SELECT count(*) FROM d{r}) AS n_ds, (SELECT count(*) FROM q{r}) AS n_cs_clusters, (SELECT count(*) FROM qm{r}) AS n_cs, (SELECT count(*) FROM r{r}) AS n_rs"
    for r in range(1, 5)
)
ORACLE["bfr_rounds"] = f"""{CLUSTERED}
{_COUNTS} UNION ALL SELECT 5::INT, (SELECT sum(n) FROM fin WHERE kind = 0)::BIGINT, (SELECT count(*) FROM fin WHERE kind = 1),
  (SELECT coalesce(sum(n), 0) FROM fin WHERE kind = 1)::BIGINT, (SELECT count(*) FROM r5)"""
LABELS = """SELECT id::BIGINT AS id, c::BIGINT AS cluster FROM d5
UNION ALL SELECT m.id::BIGINT, coalesce(f.c, -1)::BIGINT FROM qm5 m LEFT JOIN (SELECT c, unnest(born[2:]) AS b FROM fin WHERE kind = 0) f ON f.b = m.c
UNION ALL SELECT id::BIGINT, -1 FROM r5"""
ORACLE["bfr_labels"] = f"{CLUSTERED} {LABELS}"
ORACLE["bfr_checked"] = f"""{CLUSTERED}, labels AS ({LABELS})
SELECT count(*) AS n_points, count(DISTINCT id) = count(*) AS labelled_once, min(cluster) >= -1 AND max(cluster) < 10 AS in_range, 5::BIGINT AS n_rounds,
       (SELECT (sum(n) + (SELECT count(*) FROM r5))::BIGINT FROM fin) AS n_counted, count(*) FILTER (WHERE cluster >= 0) = (SELECT sum(n) FROM fin WHERE kind = 0) AS discard_set_labelled
FROM labels"""

# --- stream sketches -------------------------------------------------------------------------------------------

EVENT_STREAM = "s AS (SELECT event_id + 1 AS seq, user_id::VARCHAR AS id FROM events)"
PART_STREAM = """s AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS seq, l_partkey::VARCHAR AS id FROM lineitem)"""


def _residue(modulus: int) -> str:
    return (
        f"res AS MATERIALIZED (SELECT id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(id, ''), lambda c: ord(c)::BIGINT)),"
        f" lambda acc, c: (acc * 256 + c) % {modulus}) AS x FROM (SELECT DISTINCT id FROM s))"
    )


BLOOM = f"""{EVENT_STREAM}, {_residue(69997)}, {_family(2, 11)},
bits AS (SELECT seq, id, (a * x + b) % 69997 AS bit FROM s JOIN res USING (id), fam),
firsts AS (SELECT bit, min(seq) AS f FROM bits GROUP BY bit),
seen AS (SELECT seq, id, bool_or(f = seq) AS is_new FROM bits JOIN firsts USING (bit) GROUP BY seq, id)"""
ORACLE["bloom_seen"] = f"WITH {BLOOM} SELECT seq, id, is_new FROM seen"
ORACLE["stream_bloom_seen"] = ORACLE["bloom_seen"]
ORACLE["bloom_fpr"] = f"""
WITH {BLOOM}, x AS (SELECT (seq - 1) // 50 AS batch, id, bool_or(is_new) AS any_new FROM seen GROUP BY 1, 2),
prev AS (SELECT *, min(batch) OVER (PARTITION BY id) AS first_batch FROM x)
SELECT batch, round(count(*) FILTER (WHERE NOT any_new AND first_batch = batch) / 50, 6) AS fpr FROM prev GROUP BY batch"""
ORACLE["bloom_seen_parts"] = f"""
WITH {PART_STREAM}, {_residue(69997)}, {_family(60, 11)},
k AS (SELECT greatest(1, round(69997 / count(*) * ln(2))) AS k FROM s),
bits AS (SELECT seq, id, (a * x + b) % 69997 AS bit FROM s JOIN res USING (id), fam, k WHERE j < k),
firsts AS (SELECT bit, min(seq) AS f FROM bits GROUP BY bit)
SELECT seq, id, bool_or(f = seq) AS is_new FROM bits JOIN firsts USING (bit) GROUP BY seq, id"""
FM = f"""{_residue(69997)}, {_family(200, 23)},
h AS (SELECT DISTINCT (seq - 1) // 1000 AS batch, x FROM s JOIN res USING (id)),
v AS (SELECT batch, j, (a * x + b) % 69997 AS v FROM h, fam),
z AS (SELECT batch, j, max(CASE WHEN v = 0 THEN 10 ELSE length(bin(v)) - length(rtrim(bin(v), '0')) END) AS z FROM v GROUP BY 1, 2),
g AS (SELECT batch, j // 40 AS grp, avg(z) AS m FROM z GROUP BY 1, 2),
est AS (SELECT batch, round_even(pow(2, median(m)), 0)::BIGINT AS estimate FROM g GROUP BY batch)"""
ORACLE["fm_estimate"] = f"""
WITH {PART_STREAM}, {FM}, ex AS (SELECT (seq - 1) // 1000 AS batch, count(DISTINCT id) AS exact FROM s GROUP BY 1)
SELECT batch, exact, estimate FROM ex JOIN est USING (batch)"""
ORACLE["stream_fm_windows"] = f'WITH {EVENT_STREAM}, {FM} SELECT batch AS "window", estimate FROM est'


def _position(seed: int) -> str:
    p, m1, m2 = POSITION_PRIME, POSITION_MUL_1, POSITION_MUL_2
    h1 = f"((seq % {p}) * {m1} + (seq // {p}) * {m2} + {seed} * 16807 + 12345) % {p}"
    return (
        f"SELECT seq, (h4 * {m2} + 1) % {p} AS h FROM (SELECT seq, (h3 * h3 + {m1}) % {p} AS h4 FROM"
        f" (SELECT seq, (h2 * {m1} + seq % {p}) % {p} AS h3 FROM (SELECT seq, (h1 * h1 + {m2}) % {p} AS h2 FROM"
        f" (SELECT seq, {h1} AS h1 FROM s))))"
    )


KEPT = f"""u AS ({_position(553)}), t AS ({_position(554)}),
kept AS (SELECT CASE WHEN seq <= 100 THEN seq - 1 ELSE t.h % 100 END AS slot, seq, id
         FROM s JOIN u USING (seq) JOIN t USING (seq) WHERE seq <= 100 OR u.h / {POSITION_PRIME}.0::DOUBLE < 100.0::DOUBLE / seq)"""
LAST = "SELECT slot, seq, id FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY seq DESC) AS rk FROM kept) WHERE rk = 1"
ORACLE["reservoir_sample"] = f"WITH {PART_STREAM}, {KEPT} {LAST}"
ORACLE["stream_reservoir"] = f"WITH {EVENT_STREAM}, {KEPT} {LAST}"
ORACLE["reservoir_snapshots"] = f"""
WITH {PART_STREAM}, {KEPT}, bt AS (SELECT DISTINCT (seq - 1) // 1000 AS batch FROM s),
c AS (SELECT batch, slot, arg_max(id, seq) AS id FROM bt JOIN kept ON seq <= (batch + 1) * 1000 GROUP BY 1, 2)
SELECT (batch + 1) * 1000 AS seqnum, max(id) FILTER (WHERE slot = 0) AS id_0, max(id) FILTER (WHERE slot = 20) AS id_20,
       max(id) FILTER (WHERE slot = 40) AS id_40, max(id) FILTER (WHERE slot = 60) AS id_60, max(id) FILTER (WHERE slot = 80) AS id_80
FROM c GROUP BY batch"""
ORACLE["stream_event_windows"] = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, count(*)::BIGINT AS n FROM events GROUP BY 1"""

# --- files -----------------------------------------------------------------------------------------------------

ORACLE["entity_files"] = f"""WITH {REVIEWS}, {CITIES}
SELECT usr::VARCHAR AS user_id, item::VARCHAR AS business_id, stars, strftime(dt, '%Y-%m-%d') AS date, city, state, categories FROM reviews JOIN cities USING (item)"""
ORACLE["rating_files"] = f'WITH {REVIEWS} SELECT usr::VARCHAR AS "user", item::VARCHAR AS item, stars AS rating FROM reviews'
ORACLE["retail_files"] = """SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_custkey::VARCHAR AS customer, l_suppkey AS product
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
ORACLE["point_files"] = """SELECT vec_id AS id, label::BIGINT AS truth, unnest(range(len(embedding)))::INT AS axis, unnest(embedding)::DOUBLE AS x FROM embeddings"""
ORACLE["report_file"] = ORACLE["review_summary"]
WRITTEN_ORDERS = """o AS (SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status, o_orderpriority LIKE '1%' AS urgent, o_orderstatus = 'P' AS cut FROM orders),
bad AS (SELECT * FROM o WHERE urgent OR cut),
t AS (SELECT *, CASE WHEN urgent THEN '"n/a"' ELSE customer::VARCHAR END AS c FROM bad)"""
ORACLE["rejected_lines"] = f"""WITH {WRITTEN_ORDERS}
SELECT '{{"id":' || id || ',"customer":' || c || ',"status":"' || status || CASE WHEN cut THEN '' ELSE '"}}' END AS line,
       CASE WHEN cut THEN 'not json' ELSE 'wrong type' END AS reason, 'json' AS shape FROM t
UNION ALL SELECT id || ',' || c || CASE WHEN cut THEN '' ELSE ',"' || status || '"' END, CASE WHEN cut THEN 'field count' ELSE 'wrong type' END, 'csv' FROM t"""
ORACLE["accepted_lines"] = f"""WITH {WRITTEN_ORDERS}
SELECT id, customer, status, shape FROM o, (VALUES ('json'), ('csv')) s(shape) WHERE NOT urgent AND NOT cut"""
ORACLE["reject_counts"] = f"""WITH {WRITTEN_ORDERS}
SELECT shape, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE urgent OR cut)::BIGINT AS n_rejected FROM o, (VALUES ('json'), ('csv')) s(shape) GROUP BY shape"""
ORACLE["bfr_label_lines"] = f"{CLUSTERED} SELECT id || ',' || cluster AS line FROM ({LABELS})"
ORACLE["bfr_round_lines"] = f"""{ORACLE["bfr_rounds"].replace(_COUNTS, "SELECT 'Round ' || round || ': ' || n_ds || ',' || n_cs_clusters || ',' || n_cs || ',' || n_rs AS line FROM (" + _COUNTS)})"""
