"""DuckDB text of the packet view, used as the first CTE of every oracle."""

PACKETS = r"""
ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
         event_id % 45 AS c,
         epoch_us(ts) - 1704067200000000 AS off_us
  FROM events
), cells AS (
  SELECT ev.*, CAST(floor(c / 15) AS BIGINT) AS pi, CAST(floor(c / 5) AS BIGINT) % 3 AS di, c % 5 + 1 AS run,
         CASE event_type WHEN 'click' THEN 6 WHEN 'purchase' THEN 6 WHEN 'view' THEN 17 WHEN 'signup' THEN 17 ELSE 1 END AS proto_num,
         CASE event_type WHEN 'click' THEN 443 WHEN 'purchase' THEN 80 WHEN 'view' THEN 443 WHEN 'signup' THEN 53 END AS svc_port,
         '10.0.0.' || CAST(user_id % 2 + 2 AS VARCHAR) AS host_ip,
         CASE WHEN k % 2 = 0 THEN '93.184.216.' ELSE '192.168.1.' END || CAST(k % 3 + 1 AS VARCHAR) AS peer_ip,
         40000 + user_id % 2 AS eph_port
  FROM ev
), packets AS (
  SELECT 'capturaAgente' || CASE pi WHEN 0 THEN 'Admin' WHEN 1 THEN 'Gamer' ELSE 'Web' END
           || CASE di WHEN 0 THEN '5m' WHEN 1 THEN '15m' ELSE '1h' END || CAST(run AS VARCHAR) || '.pcapng' AS filename,
         event_id AS packet_no,
         1704067200000000 + CAST(floor(off_us / (CASE di WHEN 0 THEN 8640 WHEN 1 THEN 2880 ELSE 720 END)) AS BIGINT) AS ts_us,
         60 + CAST(floor(value) AS BIGINT) AS frame_len,
         proto_num, 'IPv4' AS ip_version, 2048 AS eth_type,
         proto_num = 6 AS is_tcp,
         proto_num = 17 OR (proto_num = 1 AND k % 5 = 0) AS is_udp,
         proto_num = 1 AS is_icmp,
         CASE WHEN event_id % 2 = 0 THEN host_ip ELSE peer_ip END AS src,
         CASE WHEN event_id % 2 = 0 THEN peer_ip ELSE host_ip END AS dst,
         CASE WHEN proto_num = 1 THEN NULL WHEN event_id % 2 = 0 THEN eph_port ELSE svc_port END AS sport,
         CASE WHEN proto_num = 1 THEN NULL WHEN event_id % 2 = 0 THEN svc_port ELSE eph_port END AS dport,
         CASE WHEN proto_num = 6 THEN (k % 4) * 10 END AS tcp_seq,
         CASE WHEN proto_num = 6 THEN (k % 3) * 10 END AS payload_len,
         CASE WHEN proto_num = 6 THEN user_id % 4 END AS tcp_flags,
         CASE WHEN proto_num = 1 THEN CASE WHEN event_id % 2 = 0 THEN 8 ELSE 0 END END AS icmp_type,
         CASE WHEN event_type = 'signup' AND event_id % 2 = 0
              THEN 'h' || CAST(user_id % 7 AS VARCHAR) || '.site' || CAST(k % 5 AS VARCHAR) || '.test' END AS dns_qname,
         CASE WHEN event_type = 'purchase' AND event_id % 2 = 0
              THEN (CASE k % 3 WHEN 0 THEN 'GET ' WHEN 1 THEN 'POST ' ELSE 'DELETE ' END) || '/' || CAST(k AS VARCHAR)
                   || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: h' || CAST(user_id % 5 AS VARCHAR) || '.test'
                   || chr(13) || chr(10) || chr(13) || chr(10) END AS http_text,
         CASE WHEN event_type = 'view' THEN CASE WHEN k % 2 = 0 THEN 'C00000000108' ELSE '400000000108' END END AS quic_hex,
         k
  FROM cells
), packets_z AS (
  SELECT * REPLACE (CASE WHEN k % 13 = 0 THEN 0 ELSE ts_us END AS ts_us) FROM packets
), packets_j AS (
  SELECT * REPLACE (ts_us + (k % 5) * 1500000 AS ts_us) FROM packets
)"""


def with_packets(body: str) -> str:
    """``body`` starts with further CTEs (``, x AS (...) SELECT``) or with SELECT."""
    return "WITH" + PACKETS + "\n" + body.strip()
