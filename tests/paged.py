"""A paged collection for tests: addresses are <folder>/<name>, and state.json in the folder says what there is."""

import json
import os


def get(url, params):
    folder, name = os.path.split(url)
    with open(os.path.join(folder, "state.json")) as f:
        state = json.load(f)
    with open(os.path.join(folder, "asked"), "a") as f:
        f.write(json.dumps([name, params]) + "\n")
    if name in state["gone"] or params["page"] in state["down"]:
        return (404 if name in state["gone"] else 400), {}, None
    items = [{"number": i, "title": f"t{i}", "labels": [i]} for i in range(state["items"].get(name, state["items"][""]))]
    at = (params["page"] - 1) * params["per_page"]
    return 200, {}, items[at : at + params["per_page"]]


def chain(url, params):
    """24 items, four at a time along next links."""
    at = int(url.rsplit("=", 1)[1]) if "=" in url else 0
    return 200, {"Link": f'<u?from={at + 4}>; rel="next"'} if at < 20 else {}, [{"number": i} for i in range(at, at + 4)]
