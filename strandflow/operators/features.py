"""Per-frame and per-group features of a trajectory: equi-joins and grouped aggregates.

`traj` is (run_id, frame, atom_id, x, y, z), `member` (kind, group_id, atom_id), `atoms` (run_id, atom_id, atom_type, is_backbone).
"""

from __future__ import annotations

from strandflow.plans.op import Op

FRAME_SLICE = Op("frame_slice", "SELECT * FROM {traj} WHERE frame >= <start> AND frame < <end>", {"start": 0, "end": 100})
ATOM_SLICE = Op("atom_slice", "SELECT t.* FROM {traj} t WHERE EXISTS (SELECT 1 FROM {atoms} a WHERE a.atom_id = t.atom_id AND a.is_backbone)")
UNIFORM_GROUPS = Op("uniform_groups", """SELECT DISTINCT 'residue' AS kind, atom_id, CAST(least(floor(atom_id / greatest(floor(n / <groups>), 1)), <groups> - 1) AS INT) AS group_id
    FROM {traj} CROSS JOIN (SELECT count(DISTINCT atom_id) AS n FROM {traj}) c""", {"groups": 5})
ID_MAPPING = Op("id_mapping", """SELECT group_id, dense_rank() OVER (ORDER BY group_id) - 1 AS idx, n_atoms, CASE WHEN group_id >= 1000 THEN CAST(floor(group_id / 1000) AS INT) END AS parent_id,
    CASE WHEN group_id >= 1000 THEN group_id % 1000 END AS sub_id, count(*) OVER (PARTITION BY CASE WHEN group_id >= 1000 THEN floor(group_id / 1000) END) - 1 AS siblings
    FROM (SELECT group_id, count(*) AS n_atoms FROM {member} GROUP BY group_id) g""")
SUBDIVIDE = Op("subdivide", """SELECT group_id AS parent_id, CAST(group_id * 1000 + floor((rn - 1) / <chunk>) + 1 AS INT) AS group_id, atom_id FROM (
    SELECT m.group_id, m.atom_id, row_number() OVER (PARTITION BY m.group_id ORDER BY round(power(t.x - c.cx, 2) + power(t.y - c.cy, 2) + power(t.z - c.cz, 2), 9), m.atom_id) AS rn
    FROM {member} m JOIN {traj} t ON t.atom_id = m.atom_id AND t.frame = 0
    JOIN (SELECT m.group_id, avg(t.x) AS cx, avg(t.y) AS cy, avg(t.z) AS cz FROM {member} m JOIN {traj} t ON t.atom_id = m.atom_id AND t.frame = 0 GROUP BY m.group_id) c ON c.group_id = m.group_id
    WHERE m.group_id <> 0) s""", {"chunk": 2})
DEFECT_ATOMS = Op("defect_atoms", "SELECT DISTINCT atom_id FROM {member} WHERE group_id <> 0")
ENCODE_TYPES = Op("encode_types", "SELECT atom_id, atom_type, CAST(dense_rank() OVER (ORDER BY atom_type) - 1 AS INT) AS type_code FROM {atoms}")
GRID_CLUSTERS = Op("grid_clusters", """SELECT atom_id, gx, gy, gz, CAST(dense_rank() OVER (ORDER BY gx, gy, gz) - 1 AS INT) AS group_id
    FROM (SELECT atom_id, CAST(floor(x / <grid>) AS INT) AS gx, CAST(floor(y / <grid>) AS INT) AS gy, CAST(floor(z / <grid>) AS INT) AS gz FROM {traj} WHERE frame = 0) c""", {"grid": 8.0})
COMPOSITION = Op("composition", "SELECT m.group_id, a.atom_type, count(*) AS n, count(*) * 1.0E0 / sum(count(*)) OVER (PARTITION BY m.group_id) AS share FROM {member} m JOIN {atoms} a ON a.atom_id = m.atom_id GROUP BY m.group_id, a.atom_type")

RMSD = Op("rmsd", """SELECT t.run_id, t.frame, sqrt(avg((power(t.x - r.x, 2) + power(t.y - r.y, 2) + power(t.z - r.z, 2)) / 3)) AS rmsd
    FROM {traj} t JOIN {traj} r ON r.run_id = t.run_id AND r.atom_id = t.atom_id AND r.frame = <reference> GROUP BY t.run_id, t.frame""", {"reference": 0})
GYRATION = Op("gyration", "SELECT run_id, frame, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rg FROM {traj} GROUP BY run_id, frame")
CENTRE = Op("centre", "SELECT run_id, frame, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {traj} GROUP BY run_id, frame")
CONTACTS = Op("contacts", """SELECT a.run_id, a.frame, count(*) AS contacts FROM {traj} a JOIN {traj} b ON b.run_id = a.run_id AND b.frame = a.frame AND a.atom_id < b.atom_id
    WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) < <cutoff> * <cutoff> GROUP BY a.run_id, a.frame""", {"cutoff": 8.0})
DIHEDRALS = Op("dihedrals", """SELECT run_id, frame, k, CASE WHEN abs(px) + abs(py) < 1E-12 THEN 0 ELSE atan2(py, px) END AS angle FROM (
    SELECT run_id, frame, k, sqrt(b2x * b2x + b2y * b2y + b2z * b2z) * (b1x * (b2y * b3z - b2z * b3y) + b1y * (b2z * b3x - b2x * b3z) + b1z * (b2x * b3y - b2y * b3x)) AS py,
      (b1y * b2z - b1z * b2y) * (b2y * b3z - b2z * b3y) + (b1z * b2x - b1x * b2z) * (b2z * b3x - b2x * b3z) + (b1x * b2y - b1y * b2x) * (b2x * b3y - b2y * b3x) AS px
    FROM (SELECT run_id, frame, atom_id AS k, (lead(x, 1) OVER w) - x AS b1x, (lead(y, 1) OVER w) - y AS b1y, (lead(z, 1) OVER w) - z AS b1z,
        (lead(x, 2) OVER w) - (lead(x, 1) OVER w) AS b2x, (lead(y, 2) OVER w) - (lead(y, 1) OVER w) AS b2y, (lead(z, 2) OVER w) - (lead(z, 1) OVER w) AS b2z,
        (lead(x, 3) OVER w) - (lead(x, 2) OVER w) AS b3x, (lead(y, 3) OVER w) - (lead(y, 2) OVER w) AS b3y, (lead(z, 3) OVER w) - (lead(z, 2) OVER w) AS b3z
      FROM {traj} WINDOW w AS (PARTITION BY run_id, frame ORDER BY atom_id)) b WHERE b3x IS NOT NULL) p""")
GROUP_CENTRES = Op("group_centres", "SELECT t.run_id, m.kind, m.group_id, t.frame, avg(t.x) AS x, avg(t.y) AS y, avg(t.z) AS z FROM {traj} t JOIN {member} m ON m.atom_id = t.atom_id GROUP BY t.run_id, m.kind, m.group_id, t.frame")
PAIR_DISTANCES = Op("pair_distances", "SELECT a.run_id, a.frame, a.group_id AS i, b.group_id AS j, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS d FROM {centres} a JOIN {centres} b ON b.run_id = a.run_id AND b.frame = a.frame AND a.group_id < b.group_id")
COORDINATION = Op("coordination", """SELECT a.run_id, a.frame, a.atom_id, count(b.atom_id) AS coord FROM {traj} a LEFT JOIN {traj} b ON b.run_id = a.run_id AND b.frame = a.frame AND b.atom_id <> a.atom_id
    AND power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) < <cutoff> * <cutoff> GROUP BY a.run_id, a.frame, a.atom_id""", {"cutoff": 8.0})
COORDINATION_HISTOGRAM = Op("coordination_histogram", "SELECT run_id, frame, coord, count(*) AS n, avg(coord * 1.0E0) AS mean FROM {coordination} WHERE coord <= 20 GROUP BY run_id, frame, coord")
DEFECTS = Op("defects", """SELECT c.atom_id, c.coord FROM {coordination} c CROSS JOIN (SELECT count(*) AS n FROM {coordination} WHERE frame = <frame> AND abs(coord - <ideal>) > <tolerance>) k
    WHERE c.frame = <frame> AND CASE WHEN k.n < <least> THEN c.coord <> <ideal> ELSE abs(c.coord - <ideal>) > <tolerance> END""", {"frame": 0, "ideal": 8, "tolerance": 2, "least": 100})
EXPAND_DEFECTS = Op("expand_defects", """SELECT atom_id FROM {defects} UNION SELECT b.atom_id FROM {traj} a JOIN {defects} d ON d.atom_id = a.atom_id JOIN {traj} b ON b.frame = a.frame
    WHERE a.frame = <frame> AND power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) < <radius> * <radius>""", {"frame": 0, "radius": 6.0})
LOCAL_STRAIN = Op("local_strain", """SELECT t.run_id, t.frame, t.atom_id, avg(sqrt(power(t.x - r.x, 2) + power(t.y - r.y, 2) + power(t.z - r.z, 2))) OVER (PARTITION BY t.run_id, t.frame) AS mean_disp,
    sqrt(power(t.x - r.x, 2) + power(t.y - r.y, 2) + power(t.z - r.z, 2)) AS disp FROM {traj} t JOIN {traj} r ON r.run_id = t.run_id AND r.atom_id = t.atom_id AND r.frame = 0""")
GROUP_FRAME_STATS = Op("group_frame_stats", """SELECT g.group_id, g.rg, CASE WHEN p.d IS NULL OR p.d < 1E-12 THEN 1.0E0 ELSE 1 / p.d END AS density FROM
    (SELECT m.group_id, sqrt(var_pop(t.x) + var_pop(t.y) + var_pop(t.z)) AS rg FROM {traj} t JOIN {member} m ON m.atom_id = t.atom_id WHERE t.frame = <frame> GROUP BY m.group_id) g LEFT JOIN
    (SELECT m.group_id, avg(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))) AS d FROM {traj} a JOIN {member} m ON m.atom_id = a.atom_id
      JOIN {member} n ON n.group_id = m.group_id JOIN {traj} b ON b.atom_id = n.atom_id AND b.frame = a.frame WHERE a.frame = <frame> AND a.atom_id < b.atom_id GROUP BY m.group_id) p ON p.group_id = g.group_id""", {"frame": 0})
GAUSSIAN_COUPLING = Op("gaussian_coupling", "SELECT i, j, exp(-d * d / (2 * <sigma> * <sigma>)) AS coupling FROM {distances} WHERE frame = <frame>", {"frame": 0, "sigma": 5.0})
