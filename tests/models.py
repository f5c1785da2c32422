"""Plain-Python definitions of the rules, to compare the Spark results with."""

from collections import defaultdict
from itertools import groupby


def threshold_model(events, window_us, threshold, distinct=False, max_evidence=20):
    """``events``: (pos, t, ip, item, source) in arrival order -> (counts, findings, burst rows).

    By definition, event by event: the edge is the newest stamp that has arrived from the address; what counts are the
    arrivals since the first one that lies within the window before the edge. A burst is a run of events that count enough.
    """
    of_ip = defaultdict(list)
    for event in events:
        of_ip[event[2]].append(event)
    counts, findings, hot = [], [], []
    for ip, own in of_ip.items():
        measured = []
        for k, event in enumerate(own):
            edge = max(t for _, t, *_ in own[: k + 1])
            first = min(i for i in range(k + 1) if own[i][1] >= edge - window_us)
            items = [item for *_, item, _ in own[first : k + 1]]
            measured.append((event, len(set(items) - {None}) if distinct else len(items), own[first][1]))
        counts += [(event[0], count, front) for event, count, front in measured]
        runs = [list(run) for enough, run in groupby(measured, key=lambda m: m[1] >= threshold) if enough]
        for number, run in enumerate(runs, 1):
            places = [event[0] for event, _, _ in run]
            hot += [(pos, number) for pos in places]
            findings.append({
                "ip": ip, "first": run[0][2], "last": max(event[1] for event, _, _ in run), "count": run[-1][1],
                "sources": {event[4] for event, _, _ in run}, "evidence": places[:max_evidence], "emit": places[0],
            })
    return counts, findings, hot
