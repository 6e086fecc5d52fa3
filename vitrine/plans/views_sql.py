"""DuckDB SQL of the derived catalogue views (FIXTURES.md section 2).

Only the raw tables are registered in the oracle, so every oracle query
inlines the views it reads as common table expressions.
"""

VIEW_SQL = {
    "users": """
SELECT CAST(s_suppkey AS BIGINT) + 1 AS id, n_name AS nom, s_name AS prenom,
       concat('s', CAST(s_suppkey AS STRING), '@example.com') AS email, 'ROLE_FOURNISSEUR' AS role,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE r_name END AS libelle, s_suppkey % 5 = 4 AS is_deleted
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT CAST(n_nationkey AS BIGINT) + 1000001, n_name, 'Admin',
       CASE WHEN n_nationkey = 3 THEN 'S3@EXAMPLE.COM' ELSE concat('n', CAST(n_nationkey AS STRING), '@example.com') END,
       'ROLE_ADMIN', CAST(NULL AS STRING), n_nationkey % 5 = 0
FROM nation
""",
    "products": """
SELECT CAST(p_partkey AS BIGINT) + 1 AS id, p_name AS libelle, concat(p_type, ' ', p_brand) AS description,
       CASE p_partkey % 4 WHEN 0 THEN NULL
         WHEN 1 THEN concat('uploads/products/', CAST(p_partkey % 10 + 1 AS STRING), '/', md5(CAST(p_partkey AS STRING)), '.jpg')
         WHEN 2 THEN concat('7/../p', CAST(p_partkey AS STRING), '.gif')
         ELSE concat(CAST(p_partkey % 10 + 1 AS STRING), '/', md5(CAST(p_partkey AS STRING)), '.png') END AS image,
       CAST(p_retailprice AS DECIMAL(10,3)) AS prix, CAST(p_partkey % 10 AS BIGINT) + 1 AS fournisseur_id,
       CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS is_deleted
FROM part
""",
    "product_variations": """
SELECT CAST(o_orderkey AS BIGINT) + 1 AS id,
       CAST(CASE WHEN o_orderkey % 500 = 7 THEN 8796093022208 ELSE o_custkey END AS BIGINT) + 1 AS product_id,
       o_orderpriority AS libelle,
       CASE WHEN o_orderkey % 4 = 0 THEN '[]' ELSE concat('{"Priorite":"', o_orderpriority, '"}') END AS attributs,
       CAST(CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE (o_orderkey % 4) * 0.5 END AS DECIMAL(10,3)) AS prix_supplement,
       CAST(floor(o_totalprice) AS BIGINT) % 50 AS stock, CAST(0 AS BIGINT) AS stock_utilise,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL
         ELSE concat('PRD-', lpad(CAST(o_custkey + 1 AS STRING), 6, '0'), '-', upper(replace(o_orderpriority, ' ', '-'))) END AS reference,
       o_orderstatus = 'F' AS is_deleted
FROM orders
""",
    "product_intake": """
SELECT id, CASE WHEN seq = 2 THEN 'Second' ELSE libelle END AS libelle, description,
       CASE seq WHEN 1 THEN prix WHEN 2 THEN '5' ELSE 'abc' END AS prix, product_type, stock, fournisseur_id, actor_id, image, seq
FROM (
SELECT CASE WHEN p_partkey % 9 = 4 THEN CAST(p_partkey AS BIGINT) + 1 ELSE CAST(p_partkey AS BIGINT) + 1099511627776 END AS id,
       CASE p_partkey % 7 WHEN 0 THEN concat('  ', p_name, ' ') WHEN 1 THEN '   ' ELSE p_name END AS libelle,
       p_type AS description,
       CASE WHEN p_partkey % 8 = 0 THEN ' 12,5 ' WHEN p_partkey % 8 = 1 THEN '1.2345' WHEN p_partkey % 8 = 2 THEN ''
            WHEN p_partkey % 8 = 3 THEN '-3' WHEN p_partkey % 16 = 12 THEN '12345678.123' WHEN p_partkey % 8 = 4 THEN 'abc'
            ELSE CAST(CAST(p_retailprice AS DECIMAL(10,3)) AS STRING) END AS prix,
       CASE p_partkey % 5 WHEN 0 THEN 'standard' WHEN 1 THEN 'bundle' WHEN 2 THEN 'variations' ELSE 'standard' END AS product_type,
       CASE p_partkey % 6 WHEN 5 THEN '-1' WHEN 4 THEN 'x' ELSE CAST(p_size AS STRING) END AS stock,
       CAST(p_partkey % 12 AS BIGINT) AS fournisseur_id,
       CAST(CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 10 + 1 WHEN p_partkey % 20 = 1 THEN 8796093022208 ELSE 1000002 END AS BIGINT) AS actor_id,
       CASE p_partkey % 6 WHEN 0 THEN concat(CAST(CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 10 + 1 ELSE p_partkey % 12 END AS STRING),
                                             '/', md5(CAST(p_partkey AS STRING)), '.png')
                          WHEN 1 THEN '../../etc/x.php' END AS image
FROM part), (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS seq)
WHERE seq = 1 OR (seq = 2 AND id % 25 = 0) OR (seq = 3 AND id % 6 = 0)
""",
    "product_deletes": """
SELECT CASE WHEN p_partkey % 39 = 0 THEN CAST(p_partkey AS BIGINT) + 1099511627776 ELSE CAST(p_partkey AS BIGINT) + 1 END AS id,
       CAST(CASE WHEN p_partkey % 3 = 1 THEN 1000002 WHEN p_partkey % 7 = 0 THEN (p_partkey + 1) % 10 + 1
                 ELSE p_partkey % 10 + 1 END AS BIGINT) AS actor_id
FROM part WHERE p_partkey % 13 = 0
""",
    "variation_deletes": """
SELECT CASE WHEN o_orderkey % 51 = 0 THEN CAST(o_orderkey AS BIGINT) + 2199023255552 ELSE CAST(o_orderkey AS BIGINT) + 1 END AS id,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1000002 WHEN o_orderkey % 5 = 0 THEN (o_custkey + 1) % 10 + 1
                 ELSE o_custkey % 10 + 1 END AS BIGINT) AS actor_id
FROM orders WHERE o_orderkey % 17 = 0
""",
    "access_requests": """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 1000002 WHEN event_id % 17 = 0 THEN 8796093022208
                      ELSE CAST(user_id % 12 AS BIGINT) + 1 END AS user_id,
       CASE WHEN event_id % 13 = 0 THEN 8796093022208 ELSE CAST(event_id % 200 AS BIGINT) + 1 END AS product_id
FROM events
""",
    "user_deletes": """
SELECT CAST(s_suppkey AS BIGINT) + CASE WHEN s_suppkey % 8 = 5 THEN 1099511627776 ELSE 1 END AS id FROM supplier WHERE s_suppkey % 4 = 1
""",
    "product_updates": """
SELECT CAST(p_partkey AS BIGINT) + 1 AS id, CASE seq WHEN 1 THEN upper(p_name) WHEN 2 THEN 'Second' ELSE 'Third' END AS libelle,
       p_type AS description,
       CASE WHEN seq = 2 THEN '8' WHEN seq = 3 THEN '3' WHEN p_partkey % 28 = 0 THEN '12345678.123' WHEN p_partkey % 2 = 0 THEN '19,900'
            ELSE '7.5' END AS prix,
       CAST(p_partkey % 12 AS BIGINT) AS fournisseur_id, p_partkey % 4 = 1 AS remove_image,
       CASE WHEN seq = 3 THEN NULL
            WHEN p_partkey % 5 = 0 THEN concat(CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 12 ELSE p_partkey % 10 + 1 END AS STRING),
                                             '/', md5(concat('n', CAST(p_partkey AS STRING))), '.webp')
            WHEN p_partkey % 5 = 1 THEN '../../etc/x.php' END AS new_image,
       CASE WHEN seq = 3 THEN CAST(p_partkey % 12 AS BIGINT) WHEN p_partkey % 3 = 0 THEN CAST(1000002 AS BIGINT)
            ELSE CAST(p_partkey % 10 AS BIGINT) + 1 END AS actor_id, seq
FROM part, (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS seq)
WHERE p_partkey % 7 = 0 AND (seq = 1 OR (seq = 2 AND (p_partkey + 1) % 11 = 0) OR (seq = 3 AND (p_partkey + 1) % 2 = 0))
""",
    "variation_forms": """
SELECT CASE WHEN o_orderkey % 40 = 1 THEN CAST(o_orderkey AS BIGINT) + 2199023255552 ELSE CAST(o_orderkey AS BIGINT) + 1 END AS id,
       CAST(o_custkey AS BIGINT) + 1 AS product_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' Lot A ' END AS libelle,
       CASE WHEN o_orderkey % 11 = 3 THEN 'not json' WHEN o_orderkey % 11 = 4 THEN '{"a":" ","b":""}' WHEN o_orderkey % 11 = 5 THEN NULL
            WHEN o_orderkey % 2 = 0 THEN '[]' ELSE '{"Couleur":"Rouge","Taille":"M"}' END AS attributs
FROM orders
""",
    "variation_changes": """
SELECT CASE WHEN o_orderkey % 40 = 0 THEN CAST(o_orderkey AS BIGINT) + 1 ELSE CAST(o_orderkey AS BIGINT) + 2199023255552 END AS id,
       CAST(o_custkey AS BIGINT) + CASE seq WHEN 3 THEN 2 ELSE 1 END AS product_id,
       CASE WHEN seq = 2 THEN ' Lot B ' WHEN seq = 3 THEN ' Lot C ' WHEN o_orderkey % 3 = 0 THEN '' ELSE ' Lot A ' END AS libelle,
       CASE WHEN o_orderkey % 11 = 3 THEN 'not json' WHEN o_orderkey % 11 = 4 THEN '{"a":" ","b":""}' WHEN o_orderkey % 11 = 5 THEN NULL
            WHEN o_orderkey % 2 = 0 THEN '[]' ELSE '{"Couleur":"Rouge","Taille":"M"}' END AS attributs,
       CASE WHEN seq = 3 THEN '1' WHEN o_orderkey % 13 = 2 THEN '99999999' ELSE '2,5' END AS prix_supplement,
       CAST(o_orderkey % 30 AS STRING) AS stock,
       CAST(CASE WHEN seq = 3 AND o_orderkey % 2 = 0 THEN (o_custkey + 2) % 10 + 1 WHEN seq = 3 THEN 1000002
                 WHEN o_orderkey % 7 = 0 THEN (o_custkey + 1) % 10 + 1 WHEN o_orderkey % 3 = 1 THEN o_custkey % 10 + 1
                 ELSE 1000002 END AS BIGINT) AS actor_id, seq
FROM orders, (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS seq)
WHERE o_orderkey % 40 IN (0, 1) AND (seq = 1 OR (seq = 2 AND o_orderkey % 120 = 0) OR (seq = 3 AND o_orderkey % 3 = 1))
""",
    "user_changes": """
SELECT * FROM (
SELECT CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS BIGINT) + 1 ELSE CAST(s_suppkey AS BIGINT) + 1099511627776 END AS id,
       CASE seq WHEN 1 THEN concat(' ', s_name, ' ') ELSE 'Second' END AS nom, 'Prenom' AS prenom,
       concat('c', CAST(s_suppkey AS STRING), '@example.com') AS email,
       CASE s_suppkey % 5 WHEN 0 THEN 'ROLE_ADMIN' WHEN 1 THEN 'ROLE_OTHER' ELSE 'ROLE_FOURNISSEUR' END AS role,
       CASE WHEN s_suppkey % 3 = 0 THEN '  ' ELSE 'Maison' END AS libelle, seq
FROM supplier, (SELECT CAST(unnest([1, 2]) AS BIGINT) AS seq)) WHERE seq = 1 OR id % 6 = 1
UNION ALL
SELECT CAST(s_suppkey AS BIGINT) + 1099511627776 + extra AS id, 'Reprise' AS nom, 'P' AS prenom,
       concat(mail, CAST(s_suppkey AS STRING), '@example.com') AS email, 'ROLE_ADMIN' AS role, CAST(NULL AS STRING) AS libelle, seq
FROM supplier, (SELECT unnest([4, 8, 4, 16]) AS every, unnest([500000, 700000, 500000, 700000]) AS extra,
                       unnest(['S', 's', 'm', 's']) AS mail, CAST(unnest([3, 4, 5, 6]) AS BIGINT) AS seq)
WHERE s_suppkey % every = 0
""",
    "email_candidates": """
SELECT CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS BIGINT) + 1 ELSE NULL END AS id,
       CASE WHEN s_suppkey % 3 = 0 THEN concat('free', CAST(s_suppkey AS STRING), '@example.com')
         ELSE concat('S', CAST(s_suppkey AS STRING), '@Example.com') END AS email
FROM supplier
""",
    "image_assets": """
SELECT concat(CAST(p_partkey % 10 + 1 AS STRING), '/', md5(CAST(p_partkey AS STRING)), CASE WHEN p_partkey % 4 = 3 THEN '.png' ELSE '.jpg' END) AS image_key,
       CAST(p_partkey AS BIGINT) * 40000 AS length,
       CASE p_partkey % 6 WHEN 0 THEN 'image/gif' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' ELSE 'image/jpeg' END AS mime
FROM part
""",
}
