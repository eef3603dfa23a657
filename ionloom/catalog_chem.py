"""Registered queries over structures, formulas and isotope evidence.

No table of the driver holds structures, so each part is one: a chain of 1 + p_size % 8 carbons with one of eight ends (by p_partkey), of which the
last can't be read. That gives 64 structures at most; what needs a graph is computed once for each and joined to the parts. Their formulas,
groups, pieces and masses follow by rule, which is what the SQL states.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _SQL_PEAKS, _arrays, _spectra, _t, query
from .functions import chem, isomers, isotopes
from .operators import peaks, similarity

#: Ends of the chain of n carbons: SMILES, the same structure written from that end, element counts in n, and functional groups.
ENDS = [
    ("O", "O{}", {"C": "n", "H": "2 * n + 2", "O": "1"}, "hydroxyl"),
    ("N", "N{}", {"C": "n", "H": "2 * n + 3", "N": "1"}, "amine"),
    ("C(=O)O", "OC(=O){}", {"C": "n + 1", "H": "2 * n + 2", "O": "2"}, "carbonyl,carboxyl,hydroxyl"),
    ("Cl", "Cl{}", {"C": "n", "H": "2 * n + 1", "Cl": "1"}, ""),
    ("c1ccccc1", "c1ccccc1{}", {"C": "n + 6", "H": "2 * n + 6"}, ""),
    ("OC", "CO{}", {"C": "n + 1", "H": "2 * n + 4", "O": "1"}, "methoxy"),
    ("C(=O)C", "CC(=O){}", {"C": "n + 2", "H": "2 * n + 4", "O": "1"}, "carbonyl"),
    ("C(", "C(", None, None),
]
_COUNTS = ("C", "H", "N", "O", "Cl")


def _structures(spark, d):
    """(sid, n, g, smiles, other): a part's structure, written from either end."""
    end = lambda at: F.element_at(F.array(*[F.lit(e[at]) for e in ENDS]), (F.col("sid") % 8 + 1).cast("int"))
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("sid"), (1 + F.col("p_size") % 8).alias("n"), (F.col("p_partkey") % 8).cast("int").alias("g"))
    chain = F.repeat(F.lit("C"), F.col("n"))
    return rows.withColumns({"smiles": F.concat(chain, end(0)), "other": F.replace(end(1), F.lit("{}"), chain)})


def _once(rows, *columns):
    """What needs a graph, once for each of the 64 structures at most, joined to the parts."""
    made = rows.select("smiles", "other").distinct().select("smiles", *columns)
    return rows.join(F.broadcast(made), "smiles")


def _end(at) -> str:
    return "CASE g " + " ".join(f"WHEN {i} THEN {at(e)}" for i, e in enumerate(ENDS) if e[2] is not None) + " END"


_SQL_STRUCTURES = f"""pt AS (SELECT p_partkey AS sid, 1 + p_size % 8 AS n, CAST(p_partkey % 8 AS INTEGER) AS g FROM part),
 ct AS (SELECT *, repeat('C', CAST(n AS INTEGER)) || ['{"', '".join(e[0] for e in ENDS)}'][g + 1] AS smiles, {", ".join(f"{_end(lambda e, x=x: e[2].get(x, '0'))} AS n_{x.lower()}" for x in _COUNTS)}, {_end(lambda e: f"'{e[3]}'")} AS groups FROM pt),
 st AS (SELECT *, CASE WHEN g < 7 THEN {" || ".join(f"CASE n_{x.lower()} WHEN 0 THEN '' WHEN 1 THEN '{x}' ELSE '{x}' || n_{x.lower()} END" for x in ("C", "H", "Cl", "N", "O"))} END AS formula FROM ct)"""
_SQL_MASS = " + ".join(f"{chem.MASS[e]} * n_{e.lower()}" for e in _COUNTS)


@query(f"""WITH {_SQL_STRUCTURES} SELECT sid, smiles, formula, groups, {", ".join(f"CAST(coalesce(n_{e.lower()}, 0) AS INTEGER) AS n_{e.lower()}" for e in _COUNTS)}, round(CAST(CASE WHEN formula IS NOT NULL THEN {_SQL_MASS} END AS DOUBLE), 4) AS mass FROM st""")
def structure_formulas(spark, d):
    """Formula, element counts, exact mass and functional groups of structures."""
    rows = _once(_structures(spark, d), chem.smiles_formula("smiles").alias("f"), F.array_join(isomers.functional_groups("smiles"), ",").alias("groups"))
    formula = F.col("f.formula")
    mass = F.when(formula.isNotNull() & (F.abs(F.col("f.mass") - chem.formula_mass(formula)) < 1e-6), F.col("f.mass"))
    return rows.select("sid", "smiles", formula.alias("formula"), "groups", *[chem.element_count(formula, e).alias(f"n_{e.lower()}") for e in _COUNTS], F.round(mass, 4).alias("mass"))


@query(f"WITH {_SQL_STRUCTURES} SELECT sid, TRUE AS same_key, TRUE AS same_bits, CAST(0 AS BIGINT) AS others FROM st WHERE g < 7")
def structure_identity(spark, d):
    """Graph keys and circular fingerprints don't depend on the way a structure is written, and no two structures share a key."""
    keys = [isomers.graph_key("smiles").alias("key"), isomers.graph_key("other").alias("key2"), isomers.fingerprint("smiles").alias("bits"), isomers.fingerprint("other").alias("bits2")]
    rows = _once(_structures(spark, d), *keys).where("key is not null")
    sharing = rows.select("smiles", "key").distinct().groupBy("key").agg((F.count("*") - 1).alias("others"))
    return rows.join(F.broadcast(sharing), "key").select("sid", (F.col("key") == F.col("key2")).alias("same_key"), (F.col("bits") == F.col("bits2")).alias("same_bits"), "others")


#: Ends that are atoms of the chain, with their hydrogens: every piece of at most two cuts is a run of atoms.
_CHAIN_ENDS = {0: [("O", 1)], 1: [("N", 2)], 5: [("O", 0), ("C", 3)]}
_weight = lambda e, h: chem.MASS[e] + h * chem.MASS["H"]
_SQL_CHAINS = f"""{_SQL_STRUCTURES}, ch AS (SELECT DISTINCT smiles, list_concat(list_concat([CAST({_weight("C", 3)!r} AS DOUBLE)], [CAST({_weight("C", 2)!r} AS DOUBLE) FOR i IN range(n - 1)]), CASE g {" ".join(f"WHEN {g} THEN [{', '.join(f'CAST({_weight(e, h)!r} AS DOUBLE)' for e, h in atoms)}]" for g, atoms in _CHAIN_ENDS.items())} END) AS w FROM st WHERE g IN (0, 1, 5)),
 ci AS (SELECT smiles, w, unnest(range(1, len(w) + 1)) AS i FROM ch), cj AS (SELECT smiles, w, i, unnest(range(i, len(w) + 1)) AS j FROM ci), cr AS (SELECT smiles, list_sum(list_slice(w, i, j)) AS mass, CAST(i > 1 AS INTEGER) + CAST(j < len(w) AS INTEGER) AS level FROM cj)"""


@query(f"""WITH {_SQL_CHAINS}, x AS (SELECT smiles, round(mass, 2) AS mass, CAST(min(level) AS INTEGER) AS level FROM cr GROUP BY smiles, round(mass, 2)) SELECT sid, x.mass, x.level, TRUE AS within_two FROM st JOIN x USING (smiles)""")
def structure_fragments(spark, d):
    """Masses of the pieces of chains and the bonds broken for each."""
    rows = _once(_structures(spark, d).where(F.col("g").isin(*_CHAIN_ENDS)), isomers.fragment_levels("smiles").alias("levels"), chem.fragment_masses("smiles").alias("two"))
    rows = rows.select("sid", "two", F.explode("levels").alias("x"))
    return rows.groupBy("sid", F.round("x.mass", 2).alias("mass")).agg(F.min("x.level").alias("level"), F.bool_or(F.array_contains("two", F.col("x.mass"))).alias("within_two"))


@query(f"""WITH {_SQL_PEAKS}, {_SQL_CHAINS}, lv AS (SELECT smiles, mass, min(level) AS level FROM cr GROUP BY smiles, mass),
 p AS (SELECT pk.sid, st.smiles, pk.it, coalesce(max(CASE level WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 END), 0) AS w FROM pk JOIN st ON st.sid = pk.sid AND g IN (0, 1, 5) LEFT JOIN lv ON lv.smiles = st.smiles AND abs(pk.mz - {chem.PROTON} - lv.mass) <= 5 GROUP BY pk.sid, st.smiles, pk.mz, pk.it)
 SELECT sid, round(sum(sqrt(it) * w) / sum(sqrt(it)) + 1e-9, 5) AS score FROM p GROUP BY sid""")
def fragment_scores(spark, d):
    """Spectra explained by the levelled pieces of their structures as protonated ions."""
    rows = _once(_structures(spark, d).where(F.col("g").isin(*_CHAIN_ENDS)), isomers.fragment_levels("smiles").alias("levels"))
    rows = rows.join(_arrays(spark, d), "sid")
    level = lambda n: F.transform(F.filter("levels", lambda x: x["level"] == n), lambda x: x["mass"])
    score = similarity.explained_levels(F.col("peaks"), [(level(0), 1.0), (level(1), 0.8), (level(2), 0.5)], [chem.PROTON], 5.0)
    return rows.select("sid", F.round(score + 1e-9, 5).alias("score"))


@query(f"""WITH {_SQL_CHAINS}, s AS (SELECT DISTINCT smiles, round(mass, 2) AS mass FROM cr WHERE level <= 1 AND mass >= 40) SELECT sid, s.mass, TRUE AS present FROM st JOIN s USING (smiles)""")
def simple_cleavages(spark, d):
    """Both sides of the single bonds of chains, from 40 on, and the whole."""
    rows = _once(_structures(spark, d).where(F.col("g").isin(*_CHAIN_ENDS)), isomers.cleavage_masses("smiles").alias("m"))
    tail = F.element_at(F.create_map(*[x for g, atoms in _CHAIN_ENDS.items() for x in (F.lit(g), F.array(*[F.lit(_weight(e, h)) for e, h in atoms]))]), F.col("g"))
    rows = rows.withColumn("w", F.concat(F.array(F.lit(_weight("C", 3))), F.array_repeat(F.lit(_weight("C", 2)), F.col("n") - 1), tail))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    sides = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array(total(F.slice("w", F.lit(1), i)), total(F.slice("w", i, F.size("w"))))))
    rows = rows.select("sid", "m", F.explode(sides).alias("side")).where("side >= 40")
    found = F.exists("m", lambda x: F.abs(x - F.col("side")) < 0.002)
    return rows.groupBy("sid", F.round("side", 2).alias("mass")).agg(F.bool_and(found).alias("present"))


@query(f"WITH {_SQL_STRUCTURES} SELECT sid, formula, TRUE AS same_formula, TRUE AS new_keys, TRUE AS distinct_keys, g = 6 OR g = 4 AND n >= 3 OR g = 0 AND n >= 3 AS moved FROM st WHERE g IN (0, 4, 6)")
def isomer_generator(spark, d):
    """Isomers of a structure have its formula and new, distinct keys; moved: whether there are some."""
    rows = _once(_structures(spark, d).where(F.col("g").isin(0, 4, 6)), chem.smiles_formula("smiles")["formula"].alias("formula"), isomers.graph_key("smiles").alias("key"), isomers.isomer_lists(20)("smiles", F.array().cast("array<string>")).alias("made"))
    keys = F.transform("made", lambda x: x["key"])
    return rows.select("sid", "formula", F.forall("made", lambda x: x["formula"] == F.col("formula")).alias("same_formula"), (~F.array_contains(keys, F.col("key"))).alias("new_keys"), (F.size(F.array_distinct(keys)) == F.size(keys)).alias("distinct_keys"), (F.size("made") > 0).alias("moved"))


_SQL_FORMULA = "fo AS (SELECT p_partkey AS sid, 1 + p_size AS c, 2 + p_size % 9 AS h, p_partkey % 5 AS n, p_partkey % 7 AS o, p_partkey % 2 AS s, p_partkey % 3 AS cl, CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS br FROM part)"
_SQL_M1 = f"({chem.C13} * c + {chem.H2} * h + {chem.N15} * n + {chem.O17} * o + {chem.S33} * s)"
_PARTS = {"C": "1 + p_size", "H": "2 + p_size % 9", "Br": "if(p_partkey % 11 = 0, 1, 0)", "Cl": "p_partkey % 3", "N": "p_partkey % 5", "O": "p_partkey % 7", "S": "p_partkey % 2"}


def _formulas(spark, d):
    p = _t(spark, d, "part")
    piece = lambda e, n: F.when(F.expr(n) == 1, e).when(F.expr(n) > 1, F.concat(F.lit(e), F.expr(n).cast("string"))).otherwise("")
    return p.select(F.col("p_partkey").alias("sid"), F.concat(*[piece(e, n) for e, n in _PARTS.items()]).alias("formula"))


@query(f"""WITH {_SQL_FORMULA} SELECT sid, round({_SQL_M1}, 6) AS m1, round({_SQL_M1} * {_SQL_M1} / 2 + {chem.O18} * o + {chem.S34} * s + {chem.CL37} * cl + {chem.BR81} * br, 6) AS m2,
 round({" + ".join(f"{chem.MASS[e]} * {e.lower()}" for e in _PARTS)}, 4) AS mass FROM fo""")
def isotope_theory(spark, d):
    """ratios of the first and second isotope peaks, and masses, from formulas."""
    rows = _formulas(spark, d).withColumn("r", chem.isotope_ratios(F.col("formula")))
    return rows.select("sid", F.round("r.m1", 6).alias("m1"), F.round("r.m2", 6).alias("m2"), F.round(chem.formula_mass(F.col("formula")), 4).alias("mass"))


#: Spectra that show something, by the name of what they show: m/z above the part's size, intensities, precursor above the size.
_ISOTOPES = {
    "chlorine": ([100.0, 150.0, 200.0, 201.997, 250.0], [0.2, 0.15, 1.0, 0.32, 0.05], 250.0),
    "bromine": ([100.0, 150.0, 200.0, 201.998, 250.0], [0.2, 0.15, 1.0, 0.98, 0.05], 250.0),
    "carbon": ([150.0, 151.003355, 300.0], [1.0, 0.108, 0.1], 300.0),
    "water": ([100.0, 200.0, 281.989, 300.0], [0.1, 0.3, 0.8, 1.0], 300.0),
    "none": ([100.0], [1.0], 300.0),
}
_NAMES = list(_ISOTOPES)


@query(f"""WITH r AS (SELECT p_partkey AS sid, ['{"', '".join(_NAMES)}'][1 + p_partkey % 5] AS name FROM part)
 SELECT sid, name, name = 'chlorine' AS chlorine, name = 'bromine' AS bromine, FALSE AS sulfur, CASE name WHEN 'carbon' THEN round(0.108 / {chem.C13}, 6) END AS carbons, CASE name WHEN 'water' THEN 'H2O' ELSE '' END AS losses,
 CAST(CASE name WHEN 'chlorine' THEN 1e-4 WHEN 'bromine' THEN 1e-4 ELSE 1 END AS DOUBLE) AS halogen, CAST(CASE name WHEN 'carbon' THEN round(greatest(1e-4, exp(-pow(0.108 / {chem.C13} - 6, 2) / 18)), 6) ELSE 1 END AS DOUBLE) AS carbon_fit,
 CAST(CASE name WHEN 'water' THEN 1.15 ELSE 1 END AS DOUBLE) AS plausible FROM r""")
def isotope_evidence(spark, d):
    """element doublets, carbon estimates and neutral losses of the parts' spectra, and how a benzene with a hydroxyl group fits them."""
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("sid"), F.element_at(F.array(*map(F.lit, _NAMES)), (1 + F.col("p_partkey") % 5).cast("int")).alias("name"), F.col("p_size").cast("double").alias("by"))
    of = lambda at: F.element_at(F.create_map(*[x for k, v in _ISOTOPES.items() for x in (F.lit(k), F.array(*map(F.lit, v[at])) if at < 2 else F.lit(v[at]))]), F.col("name"))
    rows = rows.withColumns({"x": peaks.make(F.transform(of(0), lambda m: m + F.col("by")), of(1)), "p": of(2) + F.col("by")})
    has = {e: isotopes.has_element(F.col("x"), F.col("p"), e) for e in ("Cl", "Br", "S")}
    rows = rows.withColumns({**has, "e": isotopes.carbon_estimates(F.col("x")), "lost": chem.losses(F.col("x"), F.col("p"))})
    formula = F.lit("C6H6O")
    found = F.map_from_arrays("lost", F.transform("lost", lambda x: F.lit(1.0)))
    plausible = isotopes.plausibility(found, F.array(F.lit("hydroxyl")), {"H2O": "hydroxyl"})
    return rows.select("sid", "name", F.col("Cl").alias("chlorine"), F.col("Br").alias("bromine"), F.col("S").alias("sulfur"), F.round(F.try_element_at("e", F.lit(1)), 6).alias("carbons"), F.array_join("lost", ",").alias("losses"), isotopes.halogen_consistency(formula, F.col("Cl"), F.col("Br")).alias("halogen"), F.round(isotopes.carbon_consistency(formula, F.col("e")), 6).alias("carbon_fit"), F.round(plausible, 6).alias("plausible"))


@query(f"""WITH {_SQL_PEAKS}, t AS (SELECT sid, max(it) AS top FROM pk GROUP BY sid), s AS (SELECT p_partkey AS sid, p_retailprice AS p FROM part), l AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {m})" for k, m in chem.LOSSES.items())}) AS x(name, m))
 SELECT sid, name FROM s JOIN t USING (sid), l WHERE p - m > 20 AND EXISTS (SELECT 1 FROM pk WHERE pk.sid = s.sid AND abs(pk.mz - (s.p - l.m)) <= 0.25 AND pk.it >= 0.04 * t.top)""")
def neutral_loss_names(spark, d):
    """all losses over all spectra."""
    rows = _spectra(spark, d).join(_arrays(spark, d), "sid")
    return rows.select("sid", F.explode(chem.losses(F.col("peaks"), F.col("precursor"), 0.25)).alias("name"))


@query(r"""WITH t AS (SELECT event_id, ['[' || value || ', ' || event_id || ']', value || ';' || -event_id, '  ' || value, 'none', NULL, '["' || value || '", null, "x"]'][1 + event_id % 6] AS text FROM events),
 n AS (SELECT event_id, list_transform(regexp_extract_all(coalesce(text, ''), '-?[0-9]+(\.[0-9]+)?'), lambda x: CAST(x AS DOUBLE)) AS x FROM t)
 SELECT event_id, len(x) AS n, round(coalesce(x[1], 30.0), 6) AS first, round(coalesce(list_sum(x), 0), 4) AS total, round(coalesce(list_avg([abs(y) FOR y IN x]), 25.0), 6) AS energy FROM n""")
def parsed_numbers(spark, d):
    """numbers of a text in any of its forms (JSON, list, separated, plain), the first of them or a default, and the mean energy or a default."""
    own = F.col("value").cast("string")
    e, k = _t(spark, d, "events"), F.col("event_id").cast("string")
    forms = [F.concat(F.lit("["), own, F.lit(", "), k, F.lit("]")), F.concat(own, F.lit(";"), (-F.col("event_id")).cast("string")), F.concat(F.lit("  "), own), F.lit("none"), F.lit(None).cast("string"), F.concat(F.lit('["'), own, F.lit('", null, "x"]'))]
    rows = e.select("event_id", F.element_at(F.array(*forms), (1 + F.col("event_id") % 6).cast("int")).alias("text"))
    rows = rows.withColumn("x", chem.numbers(F.col("text")))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return rows.select("event_id", F.size("x").cast("long").alias("n"), F.round(chem.first_number(F.col("text")), 6).alias("first"), F.round(total, 4).alias("total"), F.round(chem.collision_energy(F.col("text")), 6).alias("energy"))


@query("""WITH a AS (SELECT p_partkey AS sid, p_retailprice AS m, ['[M+H]+', '[M+Na]+', '[2M-H]-', '[M+2H]2+', '?'][1 + p_partkey % 5] AS adduct FROM part)
 SELECT sid, round(CASE adduct WHEN '[M+H]+' THEN m + 1.0072764521 WHEN '[M+Na]+' THEN m + 22.9892207010 WHEN '[2M-H]-' THEN 2 * m - 1.0072764521 WHEN '[M+2H]2+' THEN (m + 2.0145529041) / 2 END, 5) AS mz FROM a""")
def ion_masses(spark, d):
    """neutral masses to ions."""
    names = F.array(*[F.lit(x) for x in ("[M+H]+", "[M+Na]+", "[2M-H]-", "[M+2H]2+", "?")])
    s = _spectra(spark, d).withColumn("adduct", F.element_at(names, (1 + F.col("sid") % 5).cast("int")))
    return s.select("sid", F.round(chem.ion_mz(F.col("precursor"), F.col("adduct")), 5).alias("mz"))
