"""Jobs: named steps of an analysis, each with outputs and a fingerprint of what it gave."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterable, MutableMapping
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.functions.code import check_non_locals, function_digest, same_function, tracks
from brookloom.functions.digests import SEPARATOR, normal_path, parameter_digest, table_digest, written_digest
from brookloom.operators import commands
from brookloom.operators.graph import ALWAYS, EPHEMERAL, OUTPUT
from brookloom.plans.tables import delete, exists, path_of, rename
from brookloom.sources import files, shared

if TYPE_CHECKING:
    from brookloom.plans.pipeline import Pipeline


class JobError(Exception):
    pass


class JobContractError(JobError):
    """A job didn't give what it declares."""


class JobRedefinition(JobError):
    """A job's id is taken by another kind of job, or by other parameters."""


class OutputConflict(JobError):
    """Two jobs declare the same output."""


class NotADag(JobError):
    pass


class EphemeralChanged(JobContractError):
    """An ephemeral with constant inputs gave another output than before."""


@dataclass(frozen=True)
class UseInputHashes:
    """Returned by a loader: its fingerprint is that of its inputs."""

    payload: Any


@dataclass(frozen=True)
class ValuePlusHash:
    """Returned by a loader with a fingerprint of the caller's choice."""

    value: Any
    hexdigest: str


class Job:
    kind = OUTPUT
    #: Whether its outputs are tables in folders below the pipeline's, of these names: one listing finds which are there.
    in_folders = False
    #: Whether the job may run beside others that it doesn't need: its work is Spark's, and it leaves the driver as it was.
    beside = False

    def __init__(self, pipeline: Pipeline, outputs: Iterable[str]):
        self.outputs = sorted(outputs)
        if len(set(self.outputs)) < len(self.outputs) or not self.outputs:
            raise ValueError("outputs must be there, and different")
        for name in self.outputs:
            if "!!!" in name or SEPARATOR in name or "/../" in name:
                raise ValueError(f"{name}: no name may hold !!!, {SEPARATOR} or /../")
        self.job_id = SEPARATOR.join(self.outputs)
        self.pipeline = pipeline
        self.consumed: dict[str, set[str]] = {}
        self.deferred: list[Callable[[], Any]] = []
        pipeline.add(self)

    def depends_on(self, *what: Any) -> Job:
        """Jobs, names or paths of outputs (only these are then compared), any nesting of these, None, or functions called at
        the run's start. What ``cached`` and ``plot`` return is refused: name the job of the two or three."""
        for x in what:
            if x is None:
                continue
            if isinstance(x, (CachedJobs, PlotJobs)):
                raise TypeError(f"depend on one of {', '.join(x._fields)} of {type(x).__name__}")
            if isinstance(x, Job):
                self._consume(x, x.outputs)
            elif isinstance(x, (str, os.PathLike)):
                name = os.fspath(x) if os.fspath(x) in self.pipeline.producers else normal_path(x)
                self._consume(self.pipeline.producer(name), [name])
            elif callable(x):
                self.deferred.append(x)
            elif isinstance(x, Iterable):
                self.depends_on(*x)
            else:
                raise TypeError(f"cannot depend on {type(x).__name__}")
        return self

    def _consume(self, up: Job, names: Iterable[str]) -> None:
        if up is self or self.job_id in up.consumed:
            raise NotADag(f"{self.job_id} and {up.job_id} depend on each other")
        if self.kind == ALWAYS and not isinstance(self, JobGenerating):
            raise JobError("invariants have no upstreams")
        self.consumed.setdefault(up.job_id, set()).update(names)

    def depends_on_params(self, value: Any) -> Job:
        return self.depends_on(Parameters(self.pipeline, self.job_id.replace(SEPARATOR, ","), value))

    def depends_on_func(self, name: str, function: Callable, allowed: Iterable[str] = ()) -> Job:
        return self.depends_on(Function(self.pipeline, name, function, allowed))

    def depends_on_file(self, path: str) -> Job:
        return self.depends_on(File(self.pipeline, path))

    def tracks_function(self, function: Callable, track: bool, allowed: Iterable[str]) -> None:
        if track:
            self.depends_on(Function(self.pipeline, self.job_id.replace(SEPARATOR, ","), function, allowed))

    def run(self, inputs_hash: str) -> dict[str, str]:
        """Do the work; a fingerprint for each output."""
        raise NotImplementedError

    def same(self, old: str, new: str) -> bool:
        return old == new

    def present(self) -> bool:
        return True

    def cleanup(self) -> None:
        pass

    # what the last run said
    @property
    def outcome(self) -> str | None:
        return self.pipeline.outcomes.get(self.job_id)

    @property
    def failed(self) -> bool:
        return self.outcome == "Failed"

    @property
    def error(self) -> Exception | None:
        return self.pipeline.errors.get(self.job_id)

    @property
    def upstreams(self) -> list[Job]:
        return [self.pipeline.jobs[u] for u in self.consumed]


class CachedJobs(NamedTuple):
    load: Loading
    calc: Dataset


class PlotJobs(NamedTuple):
    plot: Job
    cache: Dataset | None
    table: Job | None


class JobList(list):
    """Jobs that take up dependencies together."""

    def depends_on(self, *what: Any) -> JobList:
        for job in self:
            job.depends_on(*what)
        return self


def flatten_jobs(what: Any) -> list[Job]:
    """The jobs of any nesting of lists, tuples and sets."""
    if isinstance(what, Job):
        return [what]
    return [j for x in what for j in flatten_jobs(x)]


def job_or_filename(pipeline: Pipeline, what: Job | str | os.PathLike) -> tuple[str, list[Job]]:
    """(name of the output or path, jobs to depend on): the job that makes it, else one for the input file; a job's first output."""
    if isinstance(what, Job):
        return what.outputs[0], [what]
    name = normal_path(what)
    return name, [pipeline.producer(name) if name in pipeline.producers else File(pipeline, name)]


class File(Job):
    """An input file, or a folder with the files below it at any depth; ``notebook``: only the cells' sources count.

    A file is told by its path from the folder on and its bytes. All files of a run are fingerprinted in one plan, and
    those whose size and modification second are as before aren't opened.
    """

    kind = ALWAYS

    def __init__(self, pipeline: Pipeline, path: str | os.PathLike, notebook: bool = False):
        self.path, self.notebook = normal_path(path), notebook
        super().__init__(pipeline, [self.path])

    def run(self, inputs_hash: str) -> dict[str, str]:
        return {self.path: self.pipeline.file_digest(self)}


class Parameters(Job):
    kind = ALWAYS

    def __init__(self, pipeline: Pipeline, name: str, value: Any):
        self.hash = parameter_digest(value)
        super().__init__(pipeline, [f"PI {name}"])

    def run(self, inputs_hash: str) -> dict[str, str]:
        return {self.job_id: self.hash}

    def redefined(self, old: Job) -> bool:
        return old.hash != self.hash


class Function(Job):
    kind = ALWAYS

    def __init__(self, pipeline: Pipeline, name: str, function: Callable, allowed: Iterable[str] = (), check: bool = True):
        if check:
            check_non_locals(function, allowed)
        self.digest = function_digest(function, allowed)
        super().__init__(pipeline, [f"FI {name}"])

    def run(self, inputs_hash: str) -> dict[str, str]:
        return {self.job_id: "|".join(self.digest[k] for k in ("python", "source", "code", "closure"))}

    def same(self, old: str, new: str) -> bool:
        a, b = (dict(zip(("python", "source", "code", "closure"), x.split("|"), strict=True)) for x in (old, new))
        return same_function(a, b)


class Dataset(Job):
    """Tables written below the pipeline's folder: ``build()`` returns one DataFrame, or one by name.

    A table is written beside its place and moved there when whole. ``empty_ok``: whether a table may have no rows.
    """

    in_folders = beside = True

    def __init__(self, pipeline: Pipeline, names: str | Iterable[str], build: Callable[[], Any], empty_ok: bool = False, track: bool = True, allowed: Iterable[str] = ()):
        self.names = [names] if isinstance(names, str) else list(names)
        self.build, self.empty_ok = build, empty_ok
        super().__init__(pipeline, self.names)
        self.tracks_function(build, track, allowed)

    def path(self, name: str | None = None) -> str:
        return f"{self.pipeline.root}/{name or self.names[0]}"

    def read(self, name: str | None = None) -> DataFrame:
        return self.pipeline.spark.read.parquet(self.path(name))

    def present(self) -> bool:
        return all(exists(self.pipeline.spark, f"{self.path(n)}/_SUCCESS") for n in self.names)

    def run(self, inputs_hash: str) -> dict[str, str]:
        made = self.build()
        made = {self.names[0]: made} if isinstance(made, DataFrame) else made
        if not isinstance(made, dict) or set(made) != set(self.names):
            raise JobContractError(f"{self.job_id} gave {sorted(made) if isinstance(made, dict) else type(made).__name__}")
        out = {}
        for name, df in made.items():
            beside = f"{self.path(name)}.new"
            out[name], rows = written_digest(df, beside)
            if not self.empty_ok and not rows:
                raise JobContractError(f"{name} has no rows")
            self.inspect(beside)
            rename(self.pipeline.spark, beside, self.path(name))
        return out

    def inspect(self, beside: str) -> None:
        """Refuse a table that is written and not yet in its place."""


class SharedDataset(Job):
    """Tables that pipelines share below ``store``: built once for equal inputs, stored once for equal rows.

    ``build`` returns one DataFrame, or one by name. Of pipelines that need it at once one builds and the others wait.
    It may depend on nothing but this job's inputs: other tables for the same key fail. What no pipeline uses is swept
    after each build once it is older than ``grace`` seconds. ``stale``: seconds without a sign of life after which a
    builder counts as dead.
    """

    beside = True

    def __init__(self, pipeline: Pipeline, store: str, names: str | Iterable[str], build: Callable[[], Any], track: bool = True, allowed: Iterable[str] = (), grace: float = 7 * 86_400.0, stale: float = 600.0):
        self.names = [names] if isinstance(names, str) else list(names)
        self.store, self.build = shared.Store(pipeline.spark, f"{store.rstrip('/')}/{'+'.join(self.names)}", stale, grace), build
        super().__init__(pipeline, [f"shared {n}" for n in self.names])
        self.tracks_function(build, track, allowed)

    def read(self, name: str | None = None) -> DataFrame:
        outputs = self.store.found(self.store.used(self.pipeline.root))
        return self.pipeline.spark.read.parquet(self.store.place(outputs[name or self.names[0]]))

    def present(self) -> bool:
        key = self.store.used(self.pipeline.root)
        return bool(key and self.store.found(key))

    def _make(self, folder: str) -> dict[str, str]:
        made = self.build()
        made = {self.names[0]: made} if isinstance(made, DataFrame) else made
        if not isinstance(made, dict) or set(made) != set(self.names):
            raise JobContractError(f"{self.job_id} gave {sorted(made) if isinstance(made, dict) else type(made).__name__}")
        return {n: written_digest(df, f"{folder}/{n}")[0] for n, df in made.items()}

    def run(self, inputs_hash: str) -> dict[str, str]:
        # said before it is looked for, so that no sweep takes it away
        self.store.use(self.pipeline.root, inputs_hash)
        fresh = self.store.found(inputs_hash) is None
        try:
            found = self.store.built(inputs_hash, f"{self.pipeline.root} {self.pipeline.run_id}", self._make)
        except shared.Conflict as e:
            raise JobContractError(f"{self.job_id}: equal inputs gave another table") from e
        if fresh:
            self.store.sweep()
        return {f"shared {n}": o for n, o in found.items()}

    def remove_unused(self) -> list[str]:
        """Delete the stored tables that no pipeline uses and that are older than ``grace``; their hashes."""
        return self.store.sweep()


class TempDataset(Dataset):
    """A dataset that is built only when another job needs it, and deleted when those are done.

    Where it is still there, with nothing changed above it and the rows that it had, it isn't built again.
    """

    kind = EPHEMERAL

    def run(self, inputs_hash: str) -> dict[str, str]:
        if self.job_id in self.pipeline.validated and self.present():
            found = {n: table_digest(self.read(n)) for n in self.names}
            if all(self.pipeline.was_output.get((self.job_id, n)) == h for n, h in found.items()):
                return found
        return super().run(inputs_hash)

    def cleanup(self) -> None:
        for n in self.names:
            delete(self.pipeline.spark, self.path(n))


class Commands(Dataset):
    """Commands that executors run, as a table: a row of ``build()`` each, with what came of it (``commands.outcomes``).

    The table is put in its place once all commands have ended with one of ``allowed_codes`` and made the files ``made``;
    otherwise the job fails, and what came of them all stays beside it in ``<name>.new`` until the next try. A task that is
    tried again runs its commands again; the table holds one outcome for each row.
    """

    def __init__(
        self, pipeline: Pipeline, name: str, build: Callable[[], DataFrame], made: Iterable[str] = (), allowed_codes: Iterable[int] = (0,), stdin: str | None = None, at_once: int | None = None,
        seconds: float | None = None, env: dict[str, str] | None = None, **more: Any,
    ):
        self.made, self.codes = list(made), sorted(set(allowed_codes))
        super().__init__(pipeline, name, build, **more)
        self.build = lambda: commands.outcomes(build(), stdin=stdin, made=self.made, at_once=at_once, seconds=seconds, env=env)
        self.depends_on_params([self.made, self.codes, stdin, seconds, env])

    def inspect(self, beside: str) -> None:
        count, shown = commands.refused(self.pipeline.spark.read.parquet(beside), self.codes, self.made)
        if count:
            raise JobError(f"{count} commands failed, see {beside}: {'; '.join(shown)}")


class TempCommands(Commands, TempDataset):
    """Commands whose table is made only when another job needs it, and deleted when those are done."""


class Loading(Job):
    """Calls ``load()`` for what it does in this process. Texts and bytes are their own fingerprints; other values that of
    the inputs."""

    kind = EPHEMERAL

    def __init__(self, pipeline: Pipeline, name: str, load: Callable[[], Any], track: bool = True, allowed: Iterable[str] = ()):
        self.load = load
        super().__init__(pipeline, [name])
        self.tracks_function(load, track, allowed)

    def keep(self, value: Any) -> None:
        pass

    def run(self, inputs_hash: str) -> dict[str, str]:
        value = self.load()
        if value is None:
            raise JobContractError(f"{self.job_id} gave None")
        if isinstance(value, ValuePlusHash):
            value, found = value.value, value.hexdigest
        elif isinstance(value, UseInputHashes):
            value, found = value.payload, inputs_hash
        else:
            found = parameter_digest(value) if isinstance(value, (str, bytes)) else inputs_hash
        self.keep(value)
        return {self.job_id: found}


class Kept(Loading):
    """A loader whose value stays in a place of this process while others need it; loaded again only if inputs changed."""

    #: What each place holds: (owner, inputs' hash, fingerprint).
    held: dict[tuple[int, str], tuple[Any, str, str]] = {}

    def place(self) -> tuple[Any, str]:
        """The object or mapping, and the attribute's or key's text."""
        raise NotImplementedError

    def has(self) -> bool:
        raise NotImplementedError

    def run(self, inputs_hash: str) -> dict[str, str]:
        owner, name = self.place()
        was = self.held.get((id(owner), name))
        if was and was[0] is owner and was[1] == inputs_hash and self.has():
            return {self.job_id: was[2]}
        found = super().run(inputs_hash)
        self.held[id(owner), name] = (owner, inputs_hash, found[self.job_id])
        return found

    def cleanup(self) -> None:
        owner, name = self.place()
        self.held.pop((id(owner), name), None)


class Attribute(Kept):
    """Keeps what ``load()`` gives as an attribute of an object, a table persisted, while others need it."""

    def __init__(self, pipeline: Pipeline, name: str, target: Any, attribute: str, load: Callable[[], Any], **more: Any):
        self.target, self.attribute = target, attribute
        super().__init__(pipeline, name, load, **more)

    def place(self) -> tuple[Any, str]:
        return self.target, self.attribute

    def has(self) -> bool:
        return hasattr(self.target, self.attribute)

    def keep(self, value: Any) -> None:
        setattr(self.target, self.attribute, value.persist() if isinstance(value, DataFrame) else value)

    def cleanup(self) -> None:
        super().cleanup()
        value = getattr(self.target, self.attribute, None)
        if isinstance(value, DataFrame):
            value.unpersist()
        if hasattr(self.target, self.attribute):
            delattr(self.target, self.attribute)


class Entry(Kept):
    """Keeps what ``load()`` gives under a key of a mapping."""

    def __init__(self, pipeline: Pipeline, name: str, target: MutableMapping, key: Any, load: Callable[[], Any], **more: Any):
        self.target, self.key = target, key
        super().__init__(pipeline, name, load, **more)

    def place(self) -> tuple[Any, str]:
        return self.target, repr(self.key)

    def has(self) -> bool:
        return self.key in self.target

    def keep(self, value: Any) -> None:
        self.target[self.key] = value.persist() if isinstance(value, DataFrame) else value

    def cleanup(self) -> None:
        super().cleanup()
        value = self.target.pop(self.key, None)
        if isinstance(value, DataFrame):
            value.unpersist()


def cached(pipeline: Pipeline, name: str, build: Callable[[], DataFrame], use: Callable[[DataFrame], Any], allowed: Iterable[str] = ()) -> CachedJobs:
    """(load, calc): a stored table, and a job that hands it to ``use`` when others need that."""
    calc = Dataset(pipeline, f"{name}.cache", build, allowed=allowed)

    def load() -> UseInputHashes:
        use(calc.read())
        return UseInputHashes(True)

    job = Loading(pipeline, name, load, track=False)
    job.depends_on(calc).depends_on_func(f"{name} use", use, allowed)
    return CachedJobs(job, calc)


def cached_in(kind: type[Kept], pipeline: Pipeline, name: str, target: Any, where: Any, build: Callable[[], DataFrame], allowed: Iterable[str] = ()) -> CachedJobs:
    """(load, calc): a stored table, kept as an attribute (``kind`` Attribute) or an entry (Entry) while others need it.

    Its fingerprint is that of the stored table, so equal rows change nothing below.
    """
    calc = Dataset(pipeline, f"{name}.cache", build, allowed=allowed)

    def load() -> ValuePlusHash:
        return ValuePlusHash(calc.read(), pipeline.hash_of(calc.job_id, calc.job_id))

    job = kind(pipeline, name, target, where, load, track=False)
    job.depends_on(calc)
    return CachedJobs(job, calc)


class Tables(Dataset):
    """One output that holds the table that ``build()`` returns, or tables by name, a folder each."""

    def run(self, inputs_hash: str) -> dict[str, str]:
        made = self.build()
        name, spark = self.names[0], self.pipeline.spark
        beside = f"{self.path()}.new"
        delete(spark, beside)
        if isinstance(made, DataFrame):
            found, rows = written_digest(made, beside)
        else:
            each = {k: written_digest(df, f"{beside}/{k}") for k, df in made.items()}
            found, rows = parameter_digest({k: d for k, (d, _) in each.items()}), sum(n for _, n in each.values())
            system, where = path_of(spark, f"{beside}/_SUCCESS")
            system.create(where).close()
        if not self.empty_ok and not rows:
            raise JobContractError(f"{name} has no rows")
        rename(spark, beside, self.path())
        return {name: found}

    def tables(self) -> dict[str, DataFrame]:
        """The tables by name; one without a name is under the empty one."""
        spark = self.pipeline.spark
        system, where = path_of(spark, self.path())
        inner = [s.getPath() for s in system.listStatus(where) if s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]
        return {p.getName(): spark.read.parquet(p.toString()) for p in sorted(inner, key=lambda p: p.getName())} or {"": self.read()}


class Dump(Job):
    """Tab-separated text of tables that ``tables()`` gives."""

    in_folders = True

    def __init__(self, pipeline: Pipeline, name: str, tables: Callable[[], dict[str, DataFrame]]):
        self.tables = tables
        super().__init__(pipeline, [name])

    def run(self, inputs_hash: str) -> dict[str, str]:
        files.tables_as_text(self.tables(), f"{self.pipeline.root}/{self.job_id}")
        return {self.job_id: inputs_hash}

    def present(self) -> bool:
        return exists(self.pipeline.spark, f"{self.pipeline.root}/{self.job_id}")


class Picture(Job):
    """A picture at ``output`` that ``draw(pandas, path)`` makes of one table, or of a dict of several.

    A table of more than ``most_rows`` rows fails before it is read: a picture is drawn in the driver.
    """

    most_rows = 1_000_000

    def __init__(self, pipeline: Pipeline, output: str, tables: Callable[[], dict[str, DataFrame]], draw: Callable[[Any, str], Any], allowed: Iterable[str] = ()):
        self.tables, self.draw = tables, draw
        super().__init__(pipeline, [output])
        self.depends_on_func(f"{output} draw", draw, allowed)

    def run(self, inputs_hash: str) -> dict[str, str]:
        tables = self.tables()
        for name, df in tables.items():
            if df.limit(self.most_rows + 1).count() > self.most_rows:
                raise JobContractError(f"{self.job_id} draws more than {self.most_rows} rows of {name or 'its table'}: aggregate them first")
        found = {k: df.toPandas() for k, df in tables.items()}
        self.draw(found[""] if set(found) == {""} else found, self.job_id)
        if not exists(self.pipeline.spark, self.job_id):
            raise JobContractError(f"{self.job_id} wasn't drawn")
        return {self.job_id: inputs_hash}

    def present(self) -> bool:
        return exists(self.pipeline.spark, self.job_id)


def plot(pipeline: Pipeline, name: str, calc: Callable[[], DataFrame | dict[str, DataFrame]], draw: Callable[[Any, str], Any], output: str, cache_calc: bool = True, create_table: bool = True, allowed: Iterable[str] = ()) -> PlotJobs:
    """(plot, cache, table): what ``calc`` gives, its tab-separated dump, and a picture that ``draw(pandas, path)`` makes of it.

    Without ``cache_calc`` nothing is stored: the picture and the dump call ``calc`` each. A plotted table is meant for
    the eye: the driver takes it whole, so aggregate first.
    """
    if cache_calc:
        cache = Tables(pipeline, f"{name}.cache", calc, allowed=allowed)
        tables, above = cache.tables, cache
    else:
        cache, above = None, Function(pipeline, f"{name} calc", calc, allowed)

        def tables() -> dict[str, DataFrame]:
            made = calc()
            return {"": made} if isinstance(made, DataFrame) else made

    picture = Picture(pipeline, output, tables, draw, allowed).depends_on(above)
    table = Dump(pipeline, f"{name}.tsv", tables).depends_on(above) if create_table else None
    return PlotJobs(picture, cache, table)


def another_plot(jobs: PlotJobs, draw: Callable[[Any, str], Any], output: str, allowed: Iterable[str] = ()) -> Job:
    """One more picture of what ``plot`` calculated."""
    above = jobs.cache or next(u for u in jobs.plot.upstreams if u.job_id.endswith(" calc"))
    return Picture(jobs.plot.pipeline, output, jobs.plot.tables, draw, allowed).depends_on(above)


class JobGenerating(Job):
    """Runs once a run and may add jobs, which a further pass takes up. What depends on it always runs again."""

    kind = ALWAYS

    def __init__(self, pipeline: Pipeline, name: str, callback: Callable[[], Any], track: bool = True):
        self.callback = callback
        super().__init__(pipeline, [name])
        self.tracks_function(callback, track, ())

    def run(self, inputs_hash: str) -> dict[str, str]:
        self.callback()
        return {self.job_id: str(self.pipeline.run_id)}


class External(Job):
    """Runs a command on the driver; keeps its output, error and return code beside ``made`` in ``folder``.

    ``prefix``: of the names of these four files. ``before`` and ``after`` are called with the job around the command,
    ``after`` only where the return code is allowed. ``own_session``: signals to this process don't reach the command.
    """

    def __init__(
        self, pipeline: Pipeline, folder: str, made: Iterable[str], command: list[str] | Callable[[], list[str]], allowed_codes: Iterable[int] = (0,), cwd: str | None = None, env: dict[str, str] | None = None,
        prefix: str = "", before: Callable[[External], Any] | None = None, after: Callable[[External], Any] | None = None, own_session: bool = False, allowed: Iterable[str] = (),
    ):
        self.folder, self.made, self.command = folder.rstrip("/"), list(made), command
        self.codes, self.cwd, self.env = set(allowed_codes), cwd, env
        self.prefix, self.before, self.after, self.own_session = prefix, before, after, own_session
        super().__init__(pipeline, [f"{self.folder}/{n}" for n in [*self.made, *(prefix + x for x in ("stdout.txt", "stderr.txt", "cmd.txt", "return_code.txt"))]])
        for name, function in (("before", before), ("after", after)):
            if function:
                self.depends_on_func(f"{self.folder} {name}", function, allowed)
        if callable(command):
            self.depends_on_func(f"{self.folder} command", command, allowed)
        else:
            self.depends_on_params(command)

    def present(self) -> bool:
        return all(exists(self.pipeline.spark, f"file://{o}") for o in self.outputs)

    def run(self, inputs_hash: str) -> dict[str, str]:
        os.makedirs(self.folder, exist_ok=True)
        if self.before:
            self.before(self)
        command = self.command() if callable(self.command) else self.command
        beside = f"{self.folder}/{self.prefix}"
        with open(f"{beside}stdout.txt", "w") as out, open(f"{beside}stderr.txt", "w") as err:
            code = subprocess.run(command, stdout=out, stderr=err, cwd=self.cwd or self.folder, env=self.env, check=False, start_new_session=self.own_session).returncode
        for name, text in (("cmd.txt", repr(command)), ("return_code.txt", str(code))):
            with open(f"{beside}{name}", "w") as f:
                f.write(text)
        if code not in self.codes:
            raise JobError(f"{command} ended with {code}")
        if lost := [o for o in self.outputs if not os.path.exists(o)]:
            raise JobContractError(f"not made: {lost}")
        if self.after:
            self.after(self)
        # an empty file gives no row
        found = files.fingerprints(self.pipeline.spark, [f"file://{o}" for o in self.outputs]).collect()
        by = {r["path"].removeprefix("file:").replace("//", "/"): r["hash"] for r in found}
        return {o: by.get(o, "empty") for o in self.outputs}


class TempExternal(External):
    """A command that runs only when another job needs its files, which are deleted when those are done."""

    kind = EPHEMERAL

    def cleanup(self) -> None:
        for o in self.outputs:
            if os.path.exists(o):
                os.remove(o)


def shell(pipeline: Pipeline, folder: str, made: Iterable[str], script: str | Callable[[], str], **more: Any) -> External:
    """A script that begins with ``#!``, or a function that gives one, written to the folder and run there."""
    if isinstance(script, str) and not script.startswith("#!"):
        raise ValueError("a script begins with #!")

    def command() -> list[str]:
        text = script() if callable(script) else script
        if not text.startswith("#!"):
            raise JobContractError("a script begins with #!")
        with open(f"{folder}/script.sh", "w") as f:
            f.write(text)
        os.chmod(f"{folder}/script.sh", 0o755)
        return [f"{folder}/script.sh"]

    job = External(pipeline, folder, made, tracks(script)(command) if callable(script) else [script], **more)
    job.command = command
    return job


def force_load(job: Job) -> Job:
    """Make a job run that nothing else needs, as tests of loaders do."""
    return JobGenerating(job.pipeline, f"force {job.job_id.replace(SEPARATOR, ',')}", lambda: None, track=False).depends_on(job)
