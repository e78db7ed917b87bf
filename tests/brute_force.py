"""The service status, worked out pair by pair in plain Python."""

from collections import defaultdict


def _lowest(values):
    known = [v for v in values if v is not None]
    return min(known) if known else None


def _highest(values):
    known = [v for v in values if v is not None]
    return max(known) if known else None


def _last(value, missing):
    return (value is None, missing if value is None else value)


def status_report(rows):
    """Report rows without their column names, and the per-line statistics."""
    fill = lambda r: r["asset_category"] or "Unknown Category"
    readings = defaultdict(list)
    for r in rows:
        if r["source"] == "hm_record" and r["asset_code"] is not None and r["date"] is not None:
            readings[fill(r), r["asset_code"], r["date"]].append(r["total_hour_meter"])
    readings = {key: _highest(values) for key, values in readings.items()}

    costs = [r for r in rows if r["source"] == "good_consume"]
    consumptions = set()
    for r in costs:
        key = (fill(r), r["asset_code"], r["asset_name"], r["product_id"], r["product_name"],
               r["date"], r["consume_id_good_consume"])
        if None not in key:
            consumptions.add(key)
    events = {(r["consume_id_assignment"], r["due_date"], r["fix_hm_record"]) for r in costs}

    merged = [(c, e) for c in consumptions for e in events if e[0] == c[6]]
    lowest = {}
    for line in {c[:4] for c, _ in merged}:
        lowest[line] = _lowest([e[2] for c, e in merged if c[:4] == line])

    lines = defaultdict(list)
    for c, e in merged:
        for (category, code, moment) in readings:
            if (category, code) == c[:2] and e[1] is not None and e[1].date() == moment.date():
                lines[c[:4]].append((c, e))

    statistics, groups = {}, defaultdict(list)
    for line, pairs in lines.items():
        pairs.sort(key=lambda p: (p[1][1].date(), p[0][4], p[0][5], p[0][6], _last(p[1][2], 0.0)))
        gaps, previous = [], None
        for c, e in pairs:
            meter = e[2]
            if meter is not None:
                gaps.append(meter - (lowest[line] if previous is None else previous))
            previous = meter
        mean = float(round(sum(gaps) / len(gaps))) if gaps else None
        statistics[line] = (mean, len(pairs))
        for c, _ in pairs:
            groups[c[0], c[1], c[2], c[4], len(pairs), c[6]].append(mean)

    latest = {}
    for (category, code, moment), meter in readings.items():
        at, top = latest.get((category, code), (None, None))
        latest[category, code] = (_highest([at, moment]), _highest([top, meter]))
    services = {}
    for r in rows:
        number = r["consume_id_assignment"]
        if number is not None:
            at, top = services.get(number, (None, None))
            services[number] = (_highest([at, r["due_date"]]), _highest([top, r["fix_hm_record"]]))

    def row(category, code, name, product, count, number, average, used, served):
        hours = None
        if used[1] is not None and served[1] is not None:
            hours = used[1] - served[1]
        status = None
        if hours is not None and average is not None:
            if hours > average:
                status = "Needed service"
            elif hours >= average - 24:
                status = "Incoming Service"
            else:
                status = "Good condition"
        elif product is None and used[0] is not None:
            status = "Product not registered in good consume record"
        return (category, code, name, product, status, count, served[0], served[1],
                used[0], used[1], average, hours)

    report = []
    for (category, code, name, product, count, number), means in groups.items():
        known = [m for m in means if m is not None]
        average = sum(known) / len(known) if known else None
        report.append(row(category, code, name, product, count, number, average,
                          latest.get((category, code), (None, None)),
                          services.get(number, (None, None))))
    with_rows = {g[:2] for g in groups}
    report += [row(*asset, None, None, None, None, None, used, (None, None))
               for asset, used in latest.items() if asset not in with_rows]
    numbers = {g[5] for g in groups}
    report += [row(None, None, None, None, None, None, None, (None, None), served)
               for number, served in services.items() if number not in numbers]
    return [r for r in report if any(v is not None for v in r)], statistics
