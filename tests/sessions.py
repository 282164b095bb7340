"""Small deterministic sessions with planted edge cases, as canonical raw events."""

from __future__ import annotations

import math

FIELDS = ("kind", "tRelMs", "payload_taskType", "payload_keyClass", "payload_repeat", "payload_x", "payload_y", "payload_xNorm", "payload_yNorm", "payload_radiusX", "payload_radiusY", "payload_force", "payload_componentId", "payload_scrollTop", "payload_ax", "payload_ay", "payload_az", "payload_alpha", "payload_beta", "payload_gamma", "taskIndex")
SCHEMA = "sessionId string, participantId string, deviceFamily string, eventIndex int, kind string, tRelMs double, payload_taskType string, payload_keyClass string, payload_repeat string, payload_x double, payload_y double, payload_xNorm double, payload_yNorm double, payload_radiusX double, payload_radiusY double, payload_force double, payload_componentId string, payload_scrollTop double, payload_ax double, payload_ay double, payload_az double, payload_alpha double, payload_beta double, payload_gamma double, taskIndex int, taskId string, activeArea string"


def session(sid: str, pid: str, seconds: float = 40.0) -> list[tuple]:
    ev: list[dict] = []
    add = lambda kind, t, **p: ev.append({"kind": kind, "tRelMs": float(t), **p})
    add("task_start", 0, payload_taskType="typing", taskIndex=0)
    add("task_end", 18_000, taskIndex=0)
    add("task_start", 20_000, payload_taskType="tapping", taskIndex=1)
    add("task_end", seconds * 1000, taskIndex=1)
    classes = ("LETTER", "LETTER", "SPACE", "BACKSPACE", "BACKSPACE", "DIGIT")
    for i in range(30):  # rollover: every third key goes down before the one before it is up
        t = 500 + i * 550 - (350 if i % 3 == 1 else 0)
        add("keydown", t, payload_keyClass=classes[i % 6], payload_repeat="true" if i % 7 == 0 else "false")
        add("keyup", 500 + i * 550 + 90 + 5 * (i % 4))
    for i in range(14):
        t = 20_500 + i * 1300
        if t + 700 > seconds * 1000:
            break
        add("touchstart", t, payload_xNorm=(i % 8) / 8.5, payload_yNorm=((3 * i) % 8) / 8.5, payload_radiusX=10.0 + i % 3, payload_radiusY=9.0, payload_force=0.1 * (i % 4), payload_componentId="continue_button" if i % 5 == 0 else "other")
        hold = 700 if i % 4 == 3 else 120
        for j in range(4 if i % 3 == 0 else 0):
            add("touchmove", t + 10 + 20 * j, payload_x=100.0 + 15 * j, payload_y=200.0 + 3 * j, payload_xNorm=0.1 + 0.02 * j, payload_yNorm=0.5)
        for j in range(5 if i % 6 == 2 else 0):
            add("scroll", t + 30 + 60 * j, payload_scrollTop=100.0 + 40.0 * j)
        add("touchcancel" if i == 5 else "touchend", t + hold)
    for i in range(int(seconds * 20)):
        t = i * 50.0
        add("devicemotion", t, payload_ax=math.sin(i / 7), payload_ay=math.cos(i / 11), payload_az=9.8 + 0.3 * math.sin(i / 3))
        add("deviceorientation", t + 7, payload_alpha=float((350 + i) % 360), payload_beta=10 + 5 * math.sin(i / 13), payload_gamma=3 * math.cos(i / 9) + 0.1 * (i % 5))
    ev.sort(key=lambda e: e["tRelMs"])
    return [(sid, pid, "mobile", n, e["kind"], e["tRelMs"], *(e.get(f) for f in FIELDS[2:]), f"task{e['taskIndex']}" if e.get("taskIndex") is not None else None, None) for n, e in enumerate(ev)]


def raw(spark):
    rows = session("s1", "p1") + session("s2", "p2", 22.5) + [r for r in session("s3", "p1", 40) if r[5] <= 14_999]
    return spark.createDataFrame(rows, SCHEMA)
