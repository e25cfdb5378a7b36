from fenwatch.plans import rendered as R
from fenwatch.sources.captures import reassemble_responses
from fenwatch.streaming import flows, services

SF = "/root/testdata/sf0.001"


def streamed(spark, made, schema, plan, restart):
    return [r.asDict(recursive=True) for r in R._streamed(spark, made, schema, plan, restart).collect()]


def key(r):
    return (r["server"], r["packet"])


def test_stream_tells_what_the_batch_tells(spark):
    """With a restart between each two triggers: cut responses, repeated ones, other protocols' ports, and payloads of nothing."""
    services.state_store(spark)
    every = R.supplier_responses(spark, SF)
    odd = spark.createDataFrame([("c", "10.9.0.1", 502, "tcp", k, None, v) for k, v in enumerate([b"", b"HTTP/1.1 200 OK", bytes.fromhex("000100000003018302")])] + [("c", "10.9.0.2", 4444, "udp", 1, None, bytes.fromhex("000100000003018302"))], services.RESPONSES)
    every = every.unionByName(odd)
    want = sorted((r.asDict(recursive=True) for r in reassemble_responses(every).collect()), key=key)
    parts = [every.where("packet <= 1"), every.where("packet = 2"), every.where("packet >= 3")]
    for restart in (True, False):
        got = sorted(streamed(spark, parts, services.RESPONSES, services.reassembled, restart), key=key)
        assert [g for g, w in zip(got, want) if g != w] == [w for g, w in zip(got, want) if g != w] and len(got) == len(want) > 20


def test_idle_flows_over_a_stream_and_a_table(spark):
    packets = R.line_packets(spark, SF)
    whole = {tuple(r) for r in flows.idle_flows(packets, "5 days", "20 days").select(sorted(flows.idle_flows(packets).columns)).collect()}
    ended = {tuple(r[c] for c in sorted(r)) for r in streamed(spark, [packets], R.PACKETS, lambda s: flows.idle_flows(s, "5 days", "20 days"), False)}
    assert ended < whole and len(whole - ended) < 0.05 * len(whole)
