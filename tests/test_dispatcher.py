import random

from quillon.streaming import dispatcher


class Plain:
    """One client's dispatcher in plain Python: a filter, a set of deleted ids, a queue and what is in flight."""

    def __init__(self, known):
        self.filter, self.dead, self.queue, self.flying, self.sent = {r[2]: (r[3], r[4]) for r in known}, {r[2] for r in known if r[5]}, {}, {}, []

    def turn(self, events):
        answers = {r[2]: r for r in sorted((r for r in events if r[3] == "ack"), key=lambda r: r[4])}
        for i, r in answers.items():
            if i not in self.flying:
                continue
            c = self.flying.pop(i)
            if r[9] and c[0]:
                self.filter.pop(i, None)
                self.dead.add(i)
            elif r[9]:
                self.filter[i] = (c[2], c[1])
            else:
                if r[9] is False and c[0]:
                    self.filter[i] = (None, c[1])
                self.queue.setdefault(i, []).insert(0, c)
        for r in sorted((r for r in events if r[3] == "claim"), key=lambda r: r[4]):
            if r[7] is None:
                self.dead.add(r[2])
            else:
                self.filter[r[2]] = (r[7], r[6])
                self.dead.discard(r[2])
        for r in sorted((r for r in events if r[3] == "cursor"), key=lambda r: r[4]):
            self.queue.setdefault(r[2], []).append((r[5], r[6], r[7], r[8], r[4]))
        for i in [i for i in self.queue if i not in self.flying]:
            cursors = self.queue.pop(i)
            deletes = [c for c in cursors if c[0]]
            best = deletes[-1] if deletes else [c for c in cursors if c[1] == max(x[1] for x in cursors)][-1]
            asked = any(c[3] for c in cursors)
            if i in self.dead:
                continue
            out = (best[0], best[1], best[2])
            if i not in self.filter:
                if not asked:
                    if best[0]:
                        self.dead.add(i)
                    continue
            elif self.filter[i][0] is None:
                out = (True, max(best[1], self.filter[i][1]) if best[0] else self.filter[i][1], None)
            elif not best[0] and (self.filter[i] == (best[2], best[1]) or best[1] < self.filter[i][1]):
                continue
            self.flying[i] = (*out, asked, best[4])
            self.sent.append((i, *out, asked))


def test_equals_a_plain_dispatcher_in_ten_files_and_after_a_restart(spark, tmp_path):
    rng, turns, seq = random.Random(11), [], 0
    known = [("a", "c", str(i), None if i % 5 == 0 else f"h{i}", "3", i % 11 == 0) for i in range(0, 40, 2)] + [("b", "c", "1", "x", "9", False)]
    for n in range(10):
        rows = []
        for _ in range(60):
            seq += 1
            client, i, kind, last = rng.choice("aab"), str(rng.randrange(40)), rng.choice(["cursor", "cursor", "claim", "ack", "ack"]), str(rng.randrange(1, 8))
            if kind == "cursor":
                gone = rng.random() < 0.2
                rows.append((client, "c", i, kind, seq, gone, last, None if gone else f"h{last}", rng.random() < 0.5, None))
            elif kind == "claim" and rng.random() < 0.3:
                rows.append((client, "c", i, kind, seq, None, last, rng.choice([None, f"h{last}", f"h{last}"]), None, None))
            elif kind == "ack":
                rows.append((client, "c", i, kind, seq, None, None, None, None, rng.choice([True, True, False, None])))
        turns.append(rows)
    plain = {c: Plain([r for r in known if r[0] == c]) for c in "ab"}
    own = spark.newSession()
    dispatcher.keyed_state(own)
    start = own.createDataFrame(known, dispatcher.FILTER)

    def run():
        stream = dispatcher.dispatching(own.readStream.schema(dispatcher.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), start)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    for n, rows in enumerate(turns):
        own.createDataFrame(rows, dispatcher.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for c in "ab":
            plain[c].turn([r for r in rows if r[0] == c])
        if n in (5, 9):
            run()
    run()  # nothing new: nothing is repeated
    got = sorted((r.client, r.id, r.is_delete, r.last_entry_id, r.hash, r.authoritative) for r in own.read.schema(dispatcher.SENT).parquet(str(tmp_path / "out")).collect())
    assert [tuple(map(str, r)) for r in got] == sorted(tuple(map(str, (c, *s))) for c in "ab" for s in plain[c].sent) and len(got) > 80
    want = {(c, i, *plain[c].filter.get(i, (None, None)), i in plain[c].dead) for c in "ab" for i in {*plain[c].filter, *plain[c].dead}}
    assert {(r.client, r.id, r.known_hash, r.known_last, r.confirmed_deleted) for r in dispatcher.filter_state(own, str(tmp_path / "cp")).collect()} == want


def test_state_partitions_follow_the_records(spark):
    """The 90,000 users of events at 60 times sf0.1 keep a dozen tasks busy; a few records are one partition."""
    own = spark.newSession()
    for records, least, most in ((0, 1, 1), (3_000, 1, 1), (90_000, 12, 24), (540_000, 72, 144)):
        dispatcher.keyed_state(own, records)
        assert least <= int(own.conf.get("spark.sql.shuffle.partitions")) <= most
