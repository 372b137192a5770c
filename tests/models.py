"""Sequential models that the operators are compared with."""

from __future__ import annotations


def cut_groups(rows, size):
    """Row numbers of each group, emitted or waiting. ``rows`` are (key, tick, alert) in order of key and arrival."""
    groups, open_, alert, previous = [], [], False, None
    for number, (key, tick, is_alert) in enumerate(rows):
        if previous and (previous[0] != key or (alert and previous[1] != tick)):
            if open_:
                groups.append(open_)
            open_, alert = [], False
        open_ = [*open_, number]
        alert = alert or is_alert
        if alert and len(open_) >= size:
            groups.append(open_)
            open_, alert = [], False
        previous = (key, tick)
    return groups + ([open_] if open_ else [])


class Slots:
    """What is watched under each name; a rename frees the old name of its container."""

    def __init__(self, watched):
        self.watched, self.active, self.names, self.sessions = watched, {}, {}, []

    def end(self, name, ts, by=None):
        container, start = self.active.pop(name)
        self.sessions.append((name, container, start, ts, by))

    def handle(self, ts, action, container, name):
        watched = name != "" and self.watched(name)
        if watched and action in ("start", "restart", "unpause", "rename"):
            old = self.names.get(container)
            if old not in (None, name) and self.active.get(old, (None,))[0] == container:
                self.end(old, ts)
            self.names[container] = name
            current = self.active.get(name)
            if current and current[0] == container:
                return
            if current:
                self.end(name, ts, container)
            self.active[name] = (container, ts)
        elif action in ("die", "stop", "destroy") or (not watched and action == "rename"):
            old = self.names.get(container)
            if old is not None and self.active.get(old, (None,))[0] == container:
                self.end(old, ts)

    def result(self):
        return self.sessions + [(name, container, start, None, None) for name, (container, start) in self.active.items()]
